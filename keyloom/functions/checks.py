"""Audits of keys: nulls, repeats, order, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .names import free


class KeyedTableError(ValueError):
    """A table or its mutations break the contract of keyed tables."""


def bad_key(df: DataFrame, key: str) -> Column:
    """Null, or NaN where the key is a floating-point number."""
    null = F.col(key).isNull()
    floating = isinstance(df.select(key).schema[0].dataType, (T.FloatType, T.DoubleType))
    return null | F.isnan(key) if floating else null


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once; counts are partial before the shuffle."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def unsorted_rows(df: DataFrame, key: str, group: str, position: str, slice_rows: int = 100_000) -> DataFrame:
    """Rows whose key is not above the one before it in their group (a file, by row position from 0).

    A group is sorted in slices of positions, so a file of any size is no single task's; a slice's
    first row looks at the last key of the slice before, from one row a slice.
    """
    (cell,) = free(df.columns, "cell")
    sliced = df.withColumn(cell, F.floor(F.col(position) / slice_rows))
    own, first = Window.partitionBy(group, cell).orderBy(position), Window.partitionBy(group).orderBy(cell)
    last = sliced.groupBy(group, cell).agg(F.max_by(F.struct(F.col(key).alias("k")), position).alias("last"))
    (before,) = free([*df.columns, cell], "before")
    last = last.select(group, cell, F.lag("last").over(first)["k"].alias(before))
    seen = sliced.join(last, [group, cell]).withColumn("previous", F.when(F.row_number().over(own) == 1, F.col(before)).otherwise(F.lag(key).over(own)))
    return seen.where(F.col("previous").isNotNull() & (F.col(key) <= F.col("previous"))).drop(cell, before)


def overlapping_blocks(stats: DataFrame) -> DataFrame:
    """Blocks that begin at or below the highest key of those before. Statistics are one row a block,
    so one window over them is small."""
    w = Window.orderBy("key_min", "key_max").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("reach", F.max("key_max").over(w)).where(F.col("key_min") <= F.col("reach"))


def check_mutations(keys: DataFrame, repeats: bool = False) -> None:
    """keys: one column ``key``. One pass: no null or NaN, and unless ``repeats`` none twice (a delete
    and an upsert of one key count as twice)."""
    found = keys.groupBy("key").agg(F.count("*").alias("n"), F.first(bad_key(keys, "key")).alias("bad")).where("bad" if repeats else "n > 1 or bad").limit(1).collect()
    if found:
        raise KeyedTableError("mutations hold a null or NaN key" if found[0].bad else f"mutations hold key {found[0].key!r} {found[0].n} times")


def same_schema(want: T.StructType, got: T.StructType) -> None:
    """Names and types in order; nullability may differ."""
    def plain(kind: T.DataType) -> str:
        return kind.simpleString()

    if [(f.name, plain(f.dataType)) for f in want] != [(f.name, plain(f.dataType)) for f in got]:
        raise KeyedTableError(f"upserts have the columns {got.simpleString()}, the table has {want.simpleString()}")
