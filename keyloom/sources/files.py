"""File operations through Spark's own file systems, and copies and moves inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few driver-side operations that a commit needs, for any Hadoop path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def qualified(self, path: str) -> str:
        p, fs = self._at(path)
        return fs.makeQualified(p).toString().rstrip("/")

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def touch(self, path: str) -> None:
        p, fs = self._at(path)
        fs.create(p, True).close()

    def rename(self, source: str, dest: str) -> None:
        p, fs = self._at(source)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(dest)):
            raise OSError(f"cannot rename {source} to {dest}")

    def below(self, path: str) -> DataFrame:
        """``path, length`` of all Parquet files below, as Spark itself lists them; no content is read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        return found.select("path", "length")

    def list(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of all Parquet files below, by path."""
        return sorted((r.path, r.length) for r in self.below(path).collect())


def whole(source: str, dest: str, move: bool) -> int:
    """Copy or move one file by way of a name of its own, so that two attempts do not meet; the
    bytes copied. A move whose source is gone and whose destination is there was done before."""
    import pyarrow.fs as pafs

    a, source_path = pafs.FileSystem.from_uri(source)
    b, dest_path = pafs.FileSystem.from_uri(dest)
    if move:
        if a.get_file_info(source_path).type != pafs.FileType.NotFound:
            a.move(source_path, dest_path)
        elif b.get_file_info(dest_path).type == pafs.FileType.NotFound:
            raise FileNotFoundError(source)
        return 0
    n = 0
    with attempt(b, dest_path) as write, a.open_input_stream(source_path) as read:
        while chunk := read.read(8 << 20):
            write.write(chunk)
            n += len(chunk)
    return n


class attempt:  # noqa: N801
    """A file that has its name only when it is complete."""

    def __init__(self, fs, path: str):
        folder, _, name = path.rpartition("/")
        self.fs, self.path, self.own = fs, path, f"{folder}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.own)
        return self.out

    def __exit__(self, kind, value, trace) -> None:
        import pyarrow.fs as pafs

        self.out.close()
        if kind is None:
            try:
                self.fs.move(self.own, self.path)
                return
            except OSError:  # some file systems do not replace: then another attempt was first
                if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
                    raise
        with suppress(OSError):
            self.fs.delete_file(self.own)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .splice import splice

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["move"] is None:
                done.append(splice([(p["file"], p["block"]) for p in row["parts"]], row["dest"]))
            else:
                done.append(whole(row["parts"][0]["file"], row["dest"], row["move"]))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["bytes"])


def place_files(spark: SparkSession, wanted: list[tuple[list[tuple[str, int | None]], str, bool | None]]) -> int:
    """wanted: (parts, dest, move) for each file. move true or false: its one part is a file to move or
    to copy byte for byte; None: the parts are row groups (all of a file where None) that become
    one file, each byte for byte. All of it inside tasks; the bytes copied."""
    if not wanted:
        return 0
    tasks = min(len(wanted), max(spark.sparkContext.defaultParallelism, len(wanted) // 64))
    df = spark.createDataFrame(wanted, "parts array<struct<file: string, block: int>>, dest string, move boolean")
    return df.repartition(tasks).mapInArrow(_place, "bytes long").agg(F.sum("bytes")).first()[0]
