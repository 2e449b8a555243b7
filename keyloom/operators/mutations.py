"""Sets of upserts and deletes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_mutations, same_schema
from ..functions.names import free, named

UPSERT, DELETE = "U", "D"


@dataclass(frozen=True)
class Mutations:
    """``df`` has the table's columns and ``op``, a column of 'U' or 'D'; a delete needs its key only.
    Order does not matter. ``by``, where a method takes it, is an expression over the given rows
    that becomes their key. A key that comes twice is an error, unless ``repeats``."""

    df: DataFrame
    key: str
    op: str = "_op"
    repeats: bool = False

    @classmethod
    def upserts(cls, rows: DataFrame, key: str, by: Column | None = None) -> Mutations:
        """Full rows that replace the row of their key or are added."""
        rows = rows if by is None else rows.withColumn(key, by)
        (op,) = free(rows.columns, "_op")
        return cls(rows.withColumn(op, F.lit(UPSERT)), key, op)

    @classmethod
    def deletes(cls, keys: DataFrame, key: str, by: Column | None = None) -> Mutations:
        """Keys to delete; other columns are ignored, so full records serve as well."""
        keys = keys if by is None else keys.withColumn(key, by)
        top = key if key in keys.columns else key.partition(".")[0]
        (op,) = free([top], "_op")
        return cls(keys.select(named(top), F.lit(DELETE).alias(op)), key, op)

    @classmethod
    def from_ops(cls, rows: DataFrame, key: str, op: str = "op", by: Column | None = None) -> Mutations:
        """Rows of the table's columns and a column of 'U' or 'D'."""
        rows = rows if by is None else rows.withColumn(key, by)
        given = named(op)
        known = F.when(given.isin(UPSERT, DELETE), given).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(given, F.lit("null")))))
        return cls(rows.withColumn(op, known), key, op)

    def repeated(self) -> Mutations:
        """The same, of keys that may come more than once: all upserts of a key stay in place of the rows
        it has, and a delete of that key does nothing beside them."""
        return replace(self, repeats=True)

    def and_(self, other: Mutations) -> Mutations:
        (op,) = free([c for m in (self, other) for c in m.df.columns if c != m.op], "_op")
        mine, more = (m.df.withColumnRenamed(m.op, op) for m in (self, other))
        return Mutations(mine.unionByName(more, allowMissingColumns=True), self.key, op, self.repeats or other.repeats)

    def completed(self, schema) -> Mutations:
        """With all columns of ``schema``; raises on other columns."""
        have = {c for c in self.df.columns if c != self.op}
        (op,) = free([*schema.fieldNames(), *have], "_op")
        full = self.df.withColumnRenamed(self.op, op)
        full = full.select(*[named(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], named(op), *[named(c) for c in full.columns if c not in schema.fieldNames() and c != op])
        same_schema(schema, full.drop(op).schema)
        return Mutations(full, self.key, op, self.repeats)

    def checked(self, schema) -> Mutations:
        """``completed``; raises on null keys too, and on repeated ones unless they may be."""
        full = self.completed(schema)
        check_mutations(full.df.select(F.col(self.key).alias("key")), self.repeats)
        return full
