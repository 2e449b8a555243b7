"""Operator 6: token ids in length-delimited binary records.

A file holds one frame for each document: length of the body (8 bytes), masked CRC-32 of
those 8 bytes (4), body, masked CRC-32 of the body (4); all little-endian. A body is a flag
byte (1: the document has an id; 2: 16-bit token ids), the document id (8 bytes) and the
token ids. A second file, the offset index, holds the byte offset of every frame and the
number of tokens before it in the file, so that a reader can take frames in any order. The
mask turns the checksum and adds a constant, so that a body that itself holds checksums does
not make weak ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import texts_by_bytes
from .encoding import encoder

HAS_ID, SHORT = 1, 2
_HEAD, _CRC, _BODY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = _HEAD.pack(len(body))
    return b"".join((head, _CRC.pack(masked_crc(head)), body, _CRC.pack(masked_crc(body))))


def read_frame(stream) -> bytes | None:
    """The next body; None at the end of the file. A wrong checksum or a cut frame is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or _CRC.unpack(head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("record header is damaged")
    n = _HEAD.unpack(head[:8])[0]
    rest = stream.read(n + 4)
    if len(rest) < n + 4 or _CRC.unpack(rest[n:])[0] != masked_crc(rest[:n]):
        raise ValueError("record body is damaged")
    return rest[:n]


def pack_body(doc_id: int | None, ids: np.ndarray) -> bytes:
    short = ids.itemsize == 2
    return _BODY.pack((doc_id is not None) * HAS_ID | short * SHORT, doc_id or 0) + ids.tobytes()


def unpack_body(body: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _BODY.unpack_from(body)
    ids = np.frombuffer(body, "<u2" if flags & SHORT else "<u4", offset=_BODY.size)
    return doc_id if flags & HAS_ID else None, ids.astype("<u4")


def read_at(uri: str, position: int) -> tuple[int | None, np.ndarray]:
    """Document number ``position`` of a file, through the offset index: a shuffled read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path + ".idx") as index:
        index.seek(16 * position)
        offset = _HEAD.unpack(index.read(8))[0]
    with fs.open_input_file(path) as data:
        data.seek(offset)
        return unpack_body(read_frame(data))


_FILES = "file string, part long, docs long, tokens long"


def _writer(folder: str, path: str, keeps_space: bool, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(path, keeps_space)
        fs, base = pafs.FileSystem.from_uri(folder)
        name, own = f"{base}/part-{task.partitionId():06d}.rec", f"{base}/.tmp-{task.taskAttemptId()}"
        end, docs, tokens, offset = np.array([end_id], enc.dtype), 0, 0, 0
        fs.create_dir(base, recursive=True)
        try:
            with fs.open_output_stream(own) as data, fs.open_output_stream(own + ".idx") as index:
                for batch in batches:
                    for a, b in texts_by_bytes(batch, "text"):
                        ids_of = enc.encode_batch([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                        for doc_id, raw in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), ids_of, strict=True):
                            ids = np.concatenate([np.frombuffer(raw, enc.dtype), end])
                            out = frame(pack_body(doc_id, ids))
                            index.write(struct.pack("<QQ", offset, tokens))
                            data.write(out)
                            docs, tokens, offset = docs + 1, tokens + len(ids), offset + len(out)
        except BaseException:
            for left in (own, own + ".idx"):
                with suppress(OSError):
                    fs.delete_file(left)
            raise
        # A retried or doubled attempt writes the same bytes under its own name; the last move wins.
        fs.move(own + ".idx", name + ".idx")
        fs.move(own, name)
        uri = folder.rstrip("/") + name[len(base) :]
        yield pa.RecordBatch.from_pydict({"file": [uri], "part": [task.partitionId()], "docs": [docs], "tokens": [tokens]})

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool = True, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; the files written, one row each:
    ``file, part, docs, tokens``, read from a stored manifest.

    ``folder`` is a URI that all executors reach (file, hdfs, s3, gs). Rows are dealt by ranges
    of (doc_id, hash of the text), so that different texts of one id, or without an id, are
    spread; rows that agree in both stand in one file. Null ids come first, repeated ids follow
    each other in the order of their hash. A null text is empty: the end id alone. An empty
    table gives empty files. Other columns are not read.
    """
    n = files or max(1, docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    manifest = f"{folder}/manifest"
    rows.mapInArrow(_writer(folder, tokenizer, keeps_space, end_id), _FILES).write.parquet(manifest)
    return docs.sparkSession.read.schema(_FILES).parquet(manifest)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path, buffer_size=1 << 20) as data:
                rows, held = [], 0
                while (body := read_frame(data)) is not None:
                    doc_id, ids = unpack_body(body)
                    rows.append((doc_id, base, ids.tobytes()))
                    base, held = base + len(ids), held + len(ids)
                    if held >= 1 << 20:
                        yield _ids(rows)
                        rows, held = [], 0
                if rows:
                    yield _ids(rows)


def _ids(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["doc_id", "start", "ids"])


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (little-endian unsigned 32-bit) of every frame of the files of a
    manifest; ``start`` counts the tokens of all documents before. Only the manifest, a row
    for each file, is ordered in one task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    n = manifest.count()
    files = files.repartitionByRange(max(1, n), "part")
    return files.select("file", "base").mapInArrow(_reader, "doc_id long, start long, ids binary")


def record_files(spark: SparkSession, manifest: DataFrame) -> list[str]:
    return [r.file for r in manifest.orderBy("part").select("file").collect()]
