"""Each micro-batch of mutations as a rewrite into the next version of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.names import free
from ..operators.mutations import Mutations
from ..operators.table import KeyedTable


def apply_stream(spark: SparkSession, changes: DataFrame, root: str, key: str, checkpoint: str, order: str | None = None, op: str = "op", **writer) -> StreamingQuery:
    """Version n + 1 of the table under ``root`` is version n with batch n applied; ``v0`` must exist.

    A batch that is run again after a failure finds its version there and does nothing, so every
    change takes effect once. order: a column whose highest value wins among a batch's changes of
    one key, of equal ones the one whose values hash highest; without it a repeated key is an error.
    """

    def apply(batch: DataFrame, number: int) -> None:
        dest = f"{root}/v{number + 1}"
        table = KeyedTable.open(spark, f"{root}/v{number}", key, validate=False)
        if table.files.exists(dest):
            return
        if order is not None:
            last = Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*batch.columns).desc())
            (n,) = free(batch.columns, "n")
            batch = batch.withColumn(n, F.row_number().over(last)).where(F.col(n) == 1).drop(n, order)
        table.rewrite(Mutations.from_ops(batch, key, op), dest)

    start: Callable = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    for k, v in writer.items():
        start = getattr(start, k)(**v) if isinstance(v, dict) else start.option(k, v)
    return start.start()
