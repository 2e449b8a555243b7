"""What a set of mutations does to the blocks of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Block:
    """One file of a keyed table, or one row ``group`` of a file; ``number`` counts from 0 in key order."""

    number: int
    file: str
    n_rows: int
    n_bytes: int
    key_min: object
    key_max: object
    group: int | None = None


@dataclass(frozen=True)
class RewritePlan:
    """blocks: in key order. dirty: numbers of blocks to be merged. gaps: positions (-1 before the first
    block) where rows are added without touching the block before. counts: (upserts, deletes) by
    position. placed: mutations with their ``_pos`` and ``_inside``."""

    blocks: list[Block]
    dirty: frozenset[int]
    gaps: frozenset[int]
    counts: dict[int, tuple[int, int]]
    placed: DataFrame = field(repr=False)

    @property
    def raw(self) -> list[Block]:
        return [b for b in self.blocks if b.number not in self.dirty]

    def layout(self, spark: SparkSession) -> DataFrame:
        """``pos, kind`` of the output in order: raw blocks, merged blocks, added rows."""
        rows = [(-1, "NEW")] if -1 in self.gaps else []
        for b in self.blocks:
            rows.append((b.number, "MERGED" if b.number in self.dirty else "RAW"))
            if b.number in self.gaps:
                rows.append((b.number, "NEW"))
        return spark.createDataFrame(rows, "pos long, kind string")

    def explain(self) -> str:
        return f"{len(self.blocks)} blocks: {len(self.blocks) - len(self.dirty)} copied, {len(self.dirty)} merged, {len(self.gaps)} new"
