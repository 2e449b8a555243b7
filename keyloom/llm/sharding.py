"""Operator 5: proportional stratified interleaving into shards, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked


def source_key(column: str = "source") -> Column:
    """A key that is never null: null and each source differ."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit(""))


def shuffle_order(seed: int, cells: int, *columns: str) -> tuple[Column, Column]:
    """(cell, hash): rows shuffled by a seeded hash, cut into ``cells`` slices of its range."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(cells), 31), F.shiftrightunsigned(h, 1)


def cells_for(rows: int) -> int:
    """Slices per group: as many as make slices and their table grow with the root of the rows."""
    return max(1, math.ceil(math.sqrt(rows) / 2))


def interleaved_shards(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Per document ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``.

    Each source is shuffled by a seeded hash and ranked; the rank r of n becomes the fraction
    (r + 0.5) / n; all rows sorted by fraction are cut into runs whose lengths differ by one at
    most (law ``rows``). So each shard has every source's share within a row or so. The method
    has no groups: equal texts may part. ``slot`` numbers a shard from 0 without gaps;
    ``grown_shard`` is null, as more shards deal all rows anew.

    Ranks are running counts over slices, so no source or key meets in one task. Null sources
    are a source of their own; null texts have size 16 and checksum 0; a null doc_id is ranked
    like any other; repeated rows each get a slot, and which one gets which does not show; an
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", source_key().alias("_s"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows, "shards")
    counts, n = rows.groupBy("_s").agg(F.count("*").alias("_n")), rows.count()
    cells = cells_for(n)
    cell, order = shuffle_order(seed, cells, "doc_id", "text_crc32", "size")
    rows = rows.withColumns({"_cell": cell, "_h": order})
    rows = ranked(rows, ["_s"], "_cell", ["_h", "doc_id", "text_crc32", "size"], None, "_rank")
    of = rows.select("_s", "_rank", "doc_id", "source", "size", "text_crc32").join(counts, "_s")
    of = of.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_n"))
    of = of.withColumns({"_all": F.lit(0), "_cell": F.floor(F.col("_f") * cells).cast("long")})
    of = ranked(of, ["_all"], "_cell", ["_f", F.xxhash64("_s"), "_s", "_rank"], None, "_pos")
    short, longer = n // shards, n % shards
    edge, pos = longer * (short + 1), F.col("_pos")
    first = F.col("_pos") < edge
    shard = F.when(first, F.floor(pos / (short + 1))).otherwise(longer + F.floor((pos - edge) / max(short, 1)))
    slot = F.when(first, pos % (short + 1)).otherwise((pos - edge) % max(short, 1))
    return of.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")

