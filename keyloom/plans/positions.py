"""The block each key falls on: the last one that begins at or below it."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.names import free, named

#: Bounds up to which they are sent to all tasks (some tens of MB).
FEW_BOUNDS = 1_000_000
#: Parts of a stretch of blocks beyond that.
PARTS = 16


def _numbers(values: pa.Array) -> np.ndarray | None:
    """Numbers in the order of the values; None for types that have none."""
    kind = values.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return values.fill_null(0).to_numpy(zero_copy_only=False)
    if pa.types.is_date32(kind) or pa.types.is_timestamp(kind):
        return values.cast(pa.int32() if pa.types.is_date32(kind) else pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return None


def last_at_or_below(spark: SparkSession, key: Column, kind: T.DataType, bounds: list, codes: list[int] | None = None, highs: list | None = None) -> Column:
    """The index of the last of the ascending ``bounds`` at or below ``key``, or -1: a binary search in
    tasks that get the key column alone. A null key has any index.

    codes: one number more than there are bounds; the result is the number at index + 1 instead.
    highs: twice the index, plus 1 where the key is not above the entry of that index.
    """
    shared = spark.sparkContext.broadcast([None if x is None else pa.array(x, to_arrow_type(kind)) for x in (bounds, highs)] + [codes])

    @arrow_udf("long")
    def find(keys: pa.Array) -> pa.Array:
        lows, tops, numbers = shared.value
        wanted, plain = _numbers(keys), _numbers(lows)
        if plain is None:
            wanted, plain = keys.to_pylist(), lows.to_pylist()
            at = np.array([-1 if k is None else bisect_right(plain, k) - 1 for k in wanted], np.int64)
        else:
            at = np.searchsorted(plain, wanted, side="right") - 1
        if numbers is not None:
            at = np.array(numbers, np.int64)[at + 1]
        if tops is not None:
            ends = _numbers(tops)
            if ends is None:
                ends = tops.to_pylist()
                inside = np.array([i >= 0 and k is not None and k <= ends[i] for i, k in zip(at.tolist(), wanted, strict=True)], bool)
            else:
                inside = (at >= 0) & (wanted <= ends[at]) if len(ends) else np.zeros(len(at), bool)
            at = at * 2 + inside
        return pa.array(at, pa.int64())

    return find(key)


def positions(rows: DataFrame, key: Column, kind: T.DataType, lows: list, highs: list, pos: str = "_pos", inside: str = "_inside", few: int = FEW_BOUNDS) -> DataFrame:
    """``rows`` with two columns: the index ``pos`` of the last of the ascending ``lows`` that is at or
    below the key, or -1, and whether the key is not above the entry of ``highs`` there.

    Up to ``few`` bounds by a binary search in each task. Beyond, tasks get every so many'th bound
    only; within such a stretch, keys and bounds are sorted together, in parts that each hold all
    bounds of the stretch, so nothing that grows with the table is broadcast and no task gets all
    keys that fall behind the last block.
    """
    spark = rows.sparkSession
    if len(lows) <= few:
        (code,) = free([*rows.columns, pos, inside], "_code")
        found = rows.withColumn(code, last_at_or_below(spark, key, kind, lows, highs=highs))
        return found.select(*[named(c) for c in rows.columns], F.shiftright(code, 1).alias(pos), (F.col(code).bitwiseAND(F.lit(1)) == 1).alias(inside))
    own = rows.select(F.struct("*").alias("row"), key.alias("k")).withColumns({"bound": F.lit(None).cast("long"), "part": F.pmod(F.xxhash64("k"), F.lit(PARTS)).cast("int")})
    bounds = spark.createDataFrame([(k, h, i) for i, (k, h) in enumerate(zip(lows, highs, strict=True))], T.StructType([T.StructField("k", kind), T.StructField("high", kind), T.StructField("bound", T.LongType())]))
    bounds = bounds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    stretch = last_at_or_below(spark, F.col("k"), kind, lows[:: -(-len(lows) // few)])
    both = own.unionByName(bounds, allowMissingColumns=True).withColumn("stretch", stretch)
    upto = Window.partitionBy("stretch", "part").orderBy(F.col("k"), F.col("bound").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumns({"at": F.coalesce(F.last("bound", ignorenulls=True).over(upto), F.lit(-1).cast("long")), "high": F.last("high", ignorenulls=True).over(upto)})
    last = last.where("row is not null").withColumn("in", F.coalesce((F.col("at") >= 0) & (F.col("k") <= F.col("high")), F.lit(False)))
    at, in_ = free(rows.columns, "at", "in")
    last = last.select("row", F.col("at").alias(at), F.col("in").alias(in_)).select("row.*", at, in_)
    return last.withColumnsRenamed({at: pos, in_: inside})
