"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One word is a run of anything but space and the control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set, in local mode only; a cluster
    without the setting is an error, as executors do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/keyloom"


_written: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``clean_up`` deletes."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process wrote to the shared folder. Results that were not read or
    written elsewhere before are lost."""
    while _written:
        _delete(spark, _written.pop())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor. The table stays until ``discard`` or ``clean_up``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialize`` returned; nothing may be read from it any more."""
    path = df._keyloom_path
    _delete(df.sparkSession, path)
    _written.remove(path)


def joined_by_key(rows: DataFrame, of: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``of``, which has one row a key and says in ``n`` how many of ``rows`` have
    it, ``total`` in all.

    Keys of more than a quarter of a partition's share are at most four times as many as there
    are partitions: those are broadcast, so a key that a third of all rows have stays where its
    rows are. All others are joined by a shuffle.
    """
    most = max(1, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(of.where(F.col(n) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(of.where(F.col(n) <= most), key)
    return cold.unionByName(rows.join(hot, key))


def texts_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` with about ``limit`` bytes of ``column`` each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield start, len(sizes)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand ``rows`` rows at most to Python at once: where rows are long, executors
    and workers hold several copies of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hand memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Tasks of a shuffle by chunks at most; beyond, a task gets several, one after the other.
MOST_TASKS = 50_000


def chunk_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of batches in parts of one ``chunk`` each."""
    import pyarrow.compute as pc

    for batch in batches:
        chunks = batch.column("chunk")
        numbers = pc.unique(chunks).to_pylist()
        for number in numbers:
            yield number, batch if len(numbers) == 1 else batch.filter(pc.equal(chunks, number))


def ranked(df: DataFrame, group: list[str], cell: str, order: list, value: str | None, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` (row number from 0 where None) within ``group``, native.

    ``cell`` numbers slices of a group such that all rows of a lower cell come first, and
    ``order`` holds within a cell. Only one narrow row per cell is summed per group, so a
    group that holds a third of all rows is still spread over all tasks.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    keys = [*group, cell]
    cells = df.groupBy(*keys).agg(F.sum(amount).alias("_cell_sum"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_cell_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("_run", F.sum(amount).over(inside) - amount)
    return (
        run.join(cells, keys)
        .withColumn(out, F.col("_run") + F.col("_cell_start"))
        .drop("_run", "_cell_start")
    )
