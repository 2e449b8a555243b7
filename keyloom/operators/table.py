"""Keyed tables: directories of Parquet files, sorted by key and disjoint in their key ranges."""

from __future__ import annotations

import datetime
import re
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import cached_property
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.checks import KeyedTableError, bad_key, check_mutations, overlapping_blocks, repeated_keys, unsorted_rows
from ..functions.names import free, named
from ..plans.positions import last_at_or_below, positions
from ..plans.rewrite_plan import Block, RewritePlan
from ..session import ship_package
from ..sources.files import Files, place_files
from ..sources.footers import block_stats, computed_stats, never_null
from .mutations import DELETE, UPSERT, Mutations

#: Bytes of input that a task of a shuffle gets.
TASK_BYTES = 64 << 20
#: Rows of one position from which on several tasks sort them.
HEAVY_ROWS = 200_000


@dataclass(frozen=True)
class WriteOptions:
    """rows_per_file: rows of a block; -1 takes the mean of the source's blocks, rounded down.
    group_rows: rows of a row group inside a file, the whole file if None. block_bytes: bytes of a
    row group, beyond which it is cut whatever its rows; -1 takes the mean of the source's, and by
    default rows alone decide. page_rows: (fewest, most) rows between checks of a page's size."""

    rows_per_file: int = -1
    group_rows: int | None = None
    compression: str = "snappy"
    block_bytes: int = 1 << 30
    page_bytes: int | None = None
    dictionary_page_bytes: int | None = None
    dictionary: bool = True
    max_padding: int = 0
    page_rows: tuple[int, int] | None = None
    page_estimate: bool | None = None
    writer_version: str = "v1"

    def __post_init__(self) -> None:
        if self.rows_per_file != -1 and self.rows_per_file <= 0 or self.group_rows is not None and self.group_rows <= 0:
            raise KeyedTableError("rows per file and per group are positive, or -1 for the mean of the source")

    def of_writer(self, rows: int, mean_bytes: int) -> dict[str, str]:
        out = {
            "compression": self.compression, "parquet.block.size": mean_bytes if self.block_bytes == -1 else self.block_bytes, "parquet.block.row.count.limit": self.group_rows or rows,
            "parquet.enable.dictionary": str(self.dictionary).lower(), "parquet.writer.max-padding": self.max_padding, "parquet.writer.version": self.writer_version,
        }
        out |= {"parquet.page.size": self.page_bytes} if self.page_bytes else {}
        out |= {"parquet.dictionary.page.size": self.dictionary_page_bytes} if self.dictionary_page_bytes else {}
        out |= {"parquet.page.size.row.check.min": self.page_rows[0], "parquet.page.size.row.check.max": self.page_rows[1]} if self.page_rows else {}
        out |= {"parquet.page.size.check.estimate": str(self.page_estimate).lower()} if self.page_estimate is not None else {}
        return {k: str(v) for k, v in out.items()}


@dataclass(frozen=True)
class RewriteReport:
    """rows_out is what was written and copied, by the footers. ``*_seconds`` are wall times: storing
    and placing the mutations, merging and writing, copying and renaming."""

    rows_in: int
    rows_out: int
    inserted: int
    updated: int
    deleted: int
    absent_deletes: int
    raw_blocks: int
    merged_blocks: int
    new_fragments: int
    files_out: int
    bytes_copied: int
    bytes_encoded: int
    plan_seconds: float
    merge_seconds: float
    commit_seconds: float

    def frame(self, spark: SparkSession) -> DataFrame:
        values = asdict(self)
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))


class KeyedTable:
    """One table at ``path``, keyed by the column ``key`` (dotted for a nested one).

    A block, the unit that a rewrite copies or merges, is a file; with ``row_groups`` it is a row
    group, and a file of which some groups are merged is put together from the bytes of all others.
    No name of a column is taken: user rows travel in a struct of their own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, row_groups: bool = False):
        ship_package(spark)
        self.spark, self.key, self.files, self.row_groups = spark, key, Files(spark), row_groups
        self.path = self.files.qualified(path)

    # --- opening and reading ---------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, validate: bool = True, compute_stats: bool = False, row_groups: bool = False) -> KeyedTable:
        """validate: bounds of the blocks are there, in order and disjoint (footers only).
        compute_stats: scan the key column where footers hold no bounds, instead of failing."""
        table = cls(spark, path, key, row_groups)
        if not table.files.exists(table.path):
            raise KeyedTableError(f"no table at {path}")
        table._compute = compute_stats
        if validate:
            _in_order(table.blocks)
        return table

    _compute = False

    @cached_property
    def listed(self) -> list[tuple[str, int]]:
        return self.files.list(self.path)

    def scan(self, ordered: bool = False) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.orderBy(self.key) if ordered else df

    @cached_property
    def schema(self) -> T.StructType:
        return self.scan().schema

    @cached_property
    def key_type(self) -> T.DataType:
        return self.scan().select(self.key).schema[0].dataType

    def lookup(self, value) -> DataFrame:
        """The row of a key: one file is opened at most."""
        return self.between(value, value)

    def between(self, low, high) -> DataFrame:
        """Rows of keys from ``low`` to ``high``, from the files that can hold them alone."""
        first = bisect_left(self.blocks, self._like_bounds(low), key=lambda b: b.key_max)
        last = bisect_right(self.blocks, self._like_bounds(high), key=lambda b: b.key_min)
        held = F.col(self.key) == F.lit(low) if low == high else F.col(self.key).between(low, high)
        return self._read(self.blocks[first:last]).where(held)

    def _like_bounds(self, value):
        """A time without a zone is local, as it is to Spark; bounds have a zone."""
        return value.astimezone() if isinstance(self.key_type, T.TimestampType) and value.tzinfo is None else value

    def _read(self, blocks: list[Block]) -> DataFrame:
        """The files of some blocks."""
        files = list(dict.fromkeys(b.file for b in blocks))
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    # --- statistics ------------------------------------------------------------------------

    def block_stats(self) -> DataFrame:
        """One row per row group, from the footers."""
        return self._stats(self.path)

    def _stats(self, path: str) -> DataFrame:
        return block_stats(self.spark, self.files.below(path), self.key, self.key_type)

    def file_stats(self) -> DataFrame:
        """One row per file that has rows. A row group without bounds is an error unless
        statistics may be computed."""
        if self._compute:
            return computed_stats(self.scan(), self.key)
        per = self.block_stats().where("n_rows > 0")
        missing = F.when(F.col("key_min").isNull() | F.col("key_max").isNull(), F.raise_error(F.concat(F.lit("no statistics of the key in "), F.col("file")))).otherwise(F.col("key_min"))
        return per.withColumn("key_min", missing).groupBy("file").agg(F.sum("n_rows").alias("n_rows"), F.min("key_min").alias("key_min"), F.max("key_max").alias("key_max"))

    @cached_property
    def blocks(self) -> list[Block]:
        """All blocks in key order: one small row each."""
        return self._blocks(self.path, self.row_groups)

    def _blocks(self, path: str, by_group: bool = False) -> list[Block]:
        """The blocks of all files below ``path``, in one job."""
        groups = [g for g in self._stats(path).toArrow().to_pylist() if g["n_rows"]]
        missing = sorted({g["file"] for g in groups if g["key_min"] is None or g["key_max"] is None})
        if missing and (by_group or not self._compute):
            raise KeyedTableError(f"{self.path}: no statistics of the key in {missing[0]}")
        found = []
        computed = {_plain(r["file"]): r for r in computed_stats(self.spark.read.schema(self.schema).parquet(*missing), self.key).toArrow().to_pylist()} if missing else {}
        for file, own in groupby(sorted(groups, key=lambda g: (g["file"], g["block"])), key=lambda g: g["file"]):
            own = list(own)
            if by_group:
                found += [(g["key_min"], g["key_max"], file, g["block"], g["n_rows"], g["n_bytes"]) for g in own]
                continue
            c = computed.get(_plain(file))
            low, high = (c["key_min"], c["key_max"]) if c else (min(g["key_min"] for g in own), max(g["key_max"] for g in own))
            found.append((low, high, file, None, sum(g["n_rows"] for g in own), own[0]["file_bytes"]))
        found.sort(key=lambda x: x[0])
        return [Block(i, file, rows, n, low, high, group) for i, (low, high, file, group, rows, n) in enumerate(found)]

    @property
    def block_count(self) -> int:
        return len(self.blocks)

    def default_sizing(self) -> DataFrame:
        """``avg_rows, avg_bytes`` of the row groups, rounded down."""
        return self.block_stats().agg(F.floor(F.avg("n_rows")).cast("long").alias("avg_rows"), F.floor(F.avg("n_bytes")).cast("long").alias("avg_bytes"))

    # --- audits ----------------------------------------------------------------------------

    def duplicate_keys(self) -> DataFrame:
        return repeated_keys(self.scan(), self.key)

    def unsorted_rows(self) -> DataFrame:
        df = self.scan().select(F.col(self.key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return unsorted_rows(df, "key", "file", "row")

    def overlaps(self) -> DataFrame:
        return overlapping_blocks(self.file_stats())

    def bad_keys(self) -> DataFrame:
        df = self.scan()
        return df.where(bad_key(df, self.key))

    # --- writing ---------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, df: DataFrame, path: str, key: str, options: WriteOptions = WriteOptions(10_000), validate: bool = True, by: Column | None = None) -> KeyedTable:
        """Sort ``df`` by key and write it in blocks of exactly ``rows_per_file`` rows, the last shorter.
        ``by``: an expression over the rows that becomes their key.

        The key column alone is sorted first, which gives the key each block begins with; then
        rows move once, to the task of their block. A source that does not give the same keys
        both times is an error.
        """
        df = df if by is None else df.withColumn(key, by)
        table = cls(spark, path, key)
        table._compute, table.schema, table.key_type = True, df.schema, df.select(key).schema[0].dataType
        rows = 10_000 if options.rows_per_file == -1 else options.rows_per_file
        with _Staging(table.files, table.path) as staging:
            keys = df.select(F.col(key).alias("k"))
            if validate:
                keys = keys.groupBy("k").agg(F.count("*").alias("n"))
            seen = {"rows": F.sum("n") if validate else F.count("*"), "keys": F.bit_xor(F.xxhash64("k"))}
            if validate:
                seen |= {"bad": F.sum(bad_key(keys, "k").cast("int")), "twice": F.sum((F.col("n") > 1).cast("int"))}
            first, firsts = _starts(spark, keys.withColumn("pos", F.lit(-1).cast("long")), rows, staging.path, seen)
            if validate and first["bad"]:
                raise KeyedTableError("the key is null or NaN in some rows")
            if validate and first["twice"]:
                raise KeyedTableError("some key occurs more than once")
            groups = [_Group(-1, k, rows) for k in firsts.get(-1, [])]
            got, out = _write_groups(table, _tagged(df, key), groups, staging.path, options, rows, merge=False)
            if (got["rows"], got["keys"] or 0) != (first["rows"] or 0, first["keys"] or 0):
                raise KeyedTableError("the source gave other keys when it was read again")
            table._commit(staging, [([(b.file, None)], True) for _, b in out])
        table._know([b for _, b in out])
        return table

    def plan(self, mutations: Mutations, force: tuple[int, ...] = ()) -> RewritePlan:
        """Blocks in whose range some mutation falls are dirty, whether or not its key exists; upserts
        outside of any range go with the block before if that is dirty, else to a fragment of
        their own; deletes there do nothing. ``force`` names blocks that are dirty anyway."""
        pos, inside = free(mutations.df.columns, "_pos", "_inside")
        return self._plan(self._placed(mutations.df, self.key, pos, inside), mutations.op, pos, inside, force)

    def _placed(self, df: DataFrame, key: str, pos: str, inside: str) -> DataFrame:
        return positions(df, F.col(key), self.key_type, [b.key_min for b in self.blocks], [b.key_max for b in self.blocks], pos, inside)

    def _plan(self, placed: DataFrame, op: str, pos: str, inside: str, force: tuple[int, ...], key: str | None = None, repeats: bool = False) -> RewritePlan:
        """key: check in the same pass that no key is null or, unless ``repeats``, comes twice."""
        per, watched = placed, Observation()
        counts = [F.sum((named(op) == o).cast("long")).alias(o) for o in (UPSERT, DELETE)]
        if key is not None:
            keys = placed.select(F.col(key).alias("k"), F.col(pos).alias("pos"), F.col(inside).alias("inside"), F.col(op).alias("op"))
            per = keys.groupBy("k", "pos").agg(F.count("*").alias("n"), F.max("inside").alias("inside"), F.sum((F.col("op") == UPSERT).cast("long")).alias("ups"))
            per = per.observe(watched, F.max(bad_key(per, "k") if repeats else (F.col("n") > 1) | bad_key(per, "k")).alias("bad"))
            pos, inside = "pos", "inside"
            counts = [F.sum("ups").alias(UPSERT), F.sum((F.col("ups") == 0).cast("long")).alias(DELETE)]
        touched = per.groupBy(F.col(pos).alias("pos")).agg(F.max(inside).alias("dirty"), *counts).collect()
        if key is not None and touched and watched.get["bad"]:  # without rows nothing is observed
            check_mutations(placed.select(F.col(key).alias("key")), repeats)
        dirty = {r.pos for r in touched if r.dirty} | set(force)
        unknown = dirty - set(range(len(self.blocks)))
        if unknown:
            raise KeyedTableError(f"there is no block {sorted(unknown)}")
        gaps = frozenset(r.pos for r in touched if r[UPSERT] and r.pos not in dirty)
        return RewritePlan(self.blocks, frozenset(dirty), gaps, {r.pos: (r[UPSERT], r[DELETE]) for r in touched}, placed)

    def rewrite(self, mutations: Mutations, dest: str, options: WriteOptions = WriteOptions(), force: tuple[int, ...] = ()) -> tuple[KeyedTable, RewriteReport]:
        """Apply ``mutations`` into a new table at ``dest``: dirty blocks are merged, all others copied
        byte for byte. Nothing is at ``dest`` unless all of it is.

        The mutations are read once and stored with their positions; all else works on that. Rows
        of dirty blocks and mutations move once, to the task of their position. Where keys of the
        mutations may repeat, files hold ``rows_per_file`` different keys, all rows of a key in one,
        so that blocks stay disjoint; row groups are not cut so.
        """
        if mutations.repeats and self.row_groups:
            raise KeyedTableError("repeated keys could fall into two row groups; rewrite by files")
        start = time.perf_counter()
        full = mutations.completed(self.schema)
        with _Staging(self.files, self.files.qualified(dest), self.path) as staging:
            asked = full.df.select(F.struct(*[named(f.name) for f in self.schema]).alias("row"), F.col(self.key).alias("k"), named(full.op).alias("op"))
            stored = _stored(self._placed(asked, "k", "pos", "inside"), f"{staging.path}/mutations")
            plan = self._plan(stored, "op", "pos", "inside", force, "k", mutations.repeats)
            never: frozenset[str] = frozenset()
            if self.row_groups:
                never, whole = self._declared(plan)
                plan = self._plan(stored, "op", "pos", "inside", (*force, *whole)) if whole else plan
            planned = time.perf_counter()
            rows = self.mean_rows if options.rows_per_file == -1 else options.rows_per_file
            touched = sorted(plan.dirty | plan.gaps)
            base = _tagged(self._rows_of(plan.dirty), self.key)
            changes = stored.where("inside or op = 'U'").select("row", "k", "op")
            groups = self._groups(plan, touched, stored, rows, staging.path)
            mean = sum(b.n_bytes for b in self.blocks) // max(1, self.block_count)
            got, out = _write_groups(self, base.unionByName(changes), groups, staging.path, options, rows, merge=True, mean_bytes=mean, never=never, repeats=mutations.repeats)
            upserts, deletes = (sum(c[i] for c in plan.counts.values()) for i in (0, 1))
            if got["added"] != upserts:
                raise KeyedTableError("the files do not hold all upserts")
            done = time.perf_counter()
            copied = self._commit(staging, self._layout(plan, out))
        table = self._made(dest)
        if not self.row_groups:
            table._know([*plan.raw, *(b for _, b in out)])
        rows_in = sum(b.n_rows for b in self.blocks)
        report = RewriteReport(
            rows_in=rows_in, rows_out=sum(b.n_rows for b in plan.raw) + got["rows"], inserted=upserts - got["updated"], updated=got["updated"], deleted=got["deleted"], absent_deletes=deletes - got["deleted"],
            raw_blocks=len(plan.raw), merged_blocks=len(plan.dirty), new_fragments=len(plan.gaps), files_out=len(self._layout(plan, out)), bytes_copied=copied, bytes_encoded=sum(b.n_bytes for _, b in out),
            plan_seconds=planned - start, merge_seconds=done - planned, commit_seconds=time.perf_counter() - done,
        )
        return table, report

    def rechunk(self, dest: str, rows: int, options: WriteOptions | None = None, coalesce: bool = False) -> KeyedTable:
        """The same rows in blocks of at most ``rows``. Blocks are split and never joined, unless
        ``coalesce``."""
        options = options or WriteOptions(rows)
        with _Staging(self.files, self.files.qualified(dest), self.path) as staging:
            df = self._rows_of(frozenset(range(self.block_count)))
            if coalesce:
                _, firsts = _starts(self.spark, df.select(F.lit(-1).cast("long").alias("pos"), F.col(self.key).alias("k")), rows, staging.path, {"rows": F.count("*")})
                groups = [_Group(-1, k, rows) for k in firsts.get(-1, [])]
            else:
                groups = [_Group(b.number, b.key_min, b.n_rows) for b in self.blocks]
            got, out = _write_groups(self, _tagged(df, self.key), groups, staging.path, options, rows, merge=False)
            if got["rows"] != sum(b.n_rows for b in self.blocks):
                raise KeyedTableError("the files do not hold all rows")
            self._commit(staging, [([(b.file, None)], True) for _, b in out])
        table = self._made(dest)
        table._know([b for _, b in out])
        return table

    @property
    def mean_rows(self) -> int:
        return max(1, sum(b.n_rows for b in self.blocks) // self.block_count) if self.blocks else 10_000

    def _made(self, dest: str) -> KeyedTable:
        table = KeyedTable(self.spark, dest, self.key, self.row_groups)
        table._compute, table.schema, table.key_type = True, self.schema, self.key_type
        return table

    def _know(self, blocks: list[Block]) -> None:
        """The blocks of a table of whole files that was just made, without another look at it."""
        blocks = sorted(blocks, key=lambda b: b.key_min)
        _in_order(blocks)
        if not self.row_groups:
            self.__dict__["blocks"] = [Block(i, f"{self.path}/{_part(i)}", b.n_rows, b.n_bytes, b.key_min, b.key_max) for i, b in enumerate(blocks)]

    def _rows_of(self, numbers: frozenset[int]) -> DataFrame:
        """Rows of some blocks. Row groups without any are skipped by the bounds of the whole, and
        by their own where they are few."""
        chosen = [b for b in self.blocks if b.number in numbers]
        df = self._read(chosen)
        if not self.row_groups or not chosen:
            return df
        files = {b.file for b in chosen}
        near = [b for b in self.blocks if b.file in files]
        held = last_at_or_below(self.spark, F.col(self.key), self.key_type, [b.key_min for b in near], codes=[0, *[int(b.number in numbers) for b in near]]) == 1
        key, ranges = F.col(self.key), chosen if len(chosen) <= 32 else [Block(0, "", 0, 0, chosen[0].key_min, chosen[-1].key_max)]
        within = F.lit(False)
        for b in ranges:
            within = within | ((key >= F.lit(b.key_min)) & (key <= F.lit(b.key_max)))
        return df.where(within).where(held)

    def _declared(self, plan: RewritePlan) -> tuple[frozenset[str], list[int]]:
        """The columns to be written as never null, and blocks to be merged for it. New row groups are
        written in one way. If all touched files declare the same columns so, that is the way;
        otherwise all columns can be null, and a touched file that declares anything else is
        merged as a whole."""
        at = {plan.blocks[max(p, 0)].file for p in plan.dirty | plan.gaps} if plan.blocks else set()
        found = never_null(self.spark, sorted(at))
        ways = set(found.values())
        if len(ways) <= 1 and not any(inside for _, inside in ways) and all(_filler(self.schema[c].dataType) is not None for columns, _ in ways for c in columns):
            return next((columns for columns, _ in ways), frozenset()), []
        return frozenset(), [b.number for b in plan.blocks if found.get(b.file, (frozenset(), False)) != (frozenset(), False)]

    def _groups(self, plan: RewritePlan, touched: list[int], stored: DataFrame, rows: int, staging: str) -> list[_Group]:
        """The touched positions, in order. A position of many rows, such as an append of a whole load
        behind the last block, is cut beforehand at the keys where its files will begin."""
        weight = {p: plan.counts.get(p, (0, 0))[0] + (self.blocks[p].n_rows if p in plan.dirty else 0) for p in touched}
        heavy = [p for p in touched if weight[p] > max(HEAVY_ROWS, 4 * rows)]
        firsts: dict[int, list] = {}
        if heavy:
            own = self._rows_of(plan.dirty & set(heavy)).select(F.col(self.key).alias("k"), F.lit(None).cast("string").alias("op"))
            own = self._placed(own, "k", "pos", "inside").unionByName(stored.where(F.col("pos").isin(heavy)).select("k", "op", "pos", "inside"))
            left = own.groupBy("pos", "k").agg(F.max("op").alias("op")).where("op is null or op = 'U'").select("pos", "k")
            _, firsts = _starts(self.spark, left, rows, staging, {"rows": F.count("*")})
        out = []
        for p in touched:
            begin = self.blocks[p].key_min if p >= 0 else None
            out.append(_Group(p, begin, min(weight[p], rows) if p in firsts else weight[p]))
            out += [_Group(p, k, rows) for k in firsts.get(p, [])[1:]]
        return out

    def _layout(self, plan: RewritePlan, out: list[tuple[int, Block]]) -> list[tuple[list[tuple[str, int | None]], bool | None]]:
        """The files of a new table in key order: (parts, move), as ``place_files`` takes them."""
        if not self.row_groups or not self.blocks:
            order = sorted([((b.number, 0, 0), b.file, False) for b in plan.raw] + [((pos, 1, i), b.file, True) for i, (pos, b) in enumerate(out)])
            return [([(f, None)], move) for _, f, move in order]
        files: dict[str, list[tuple[str, int | None]]] = {b.file: [] for b in self.blocks}
        first = self.blocks[0].file
        new: dict[int, list[str]] = {}
        for pos, b in out:
            new.setdefault(pos, []).append(b.file)
        files[first] += [(f, None) for f in new.get(-1, [])]
        whole = {b.file for b in self.blocks}
        for b in self.blocks:
            if b.number not in plan.dirty:
                files[b.file].append((b.file, b.group))
            if b.number in plan.dirty or b.number in new:
                whole.discard(b.file)
            files[b.file] += [(f, None) for f in new.get(b.number, [])]
        if -1 in new:
            whole.discard(first)
        return [([(f, None)], False) if f in whole else (parts, None) for f, parts in files.items() if parts]

    def _commit(self, staging: _Staging, layout: list) -> int:
        return staging.commit([(parts, f"{staging.path}/table/{_part(i)}", move) for i, (parts, move) in enumerate(layout)], self.schema)


@dataclass(frozen=True)
class _Group:
    """Rows of one position from the key ``start`` on (from below all keys if None) up to the next
    group's; ``rows``: about how many."""

    pos: int
    start: object
    rows: int


def _plain(uri: str) -> str:
    """A path in one form, however it was written."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(uri))


def _part(number: int) -> str:
    return f"part-{number:08d}.parquet"


def _in_order(blocks: list[Block]) -> None:
    for a, b in zip(blocks, blocks[1:]):
        if not a.key_max < b.key_min:
            raise KeyedTableError(f"blocks overlap: {a.file} ends at {a.key_max!r:.100}, {b.file} begins at {b.key_min!r:.100}")


def _tagged(df: DataFrame, key: str) -> DataFrame:
    """``row`` with all columns, the key ``k``, and no ``op``."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), F.col(key).alias("k"), F.lit(None).cast("string").alias("op"))


@contextmanager
def _microseconds(spark: SparkSession) -> Iterator[None]:
    """Timestamps as numbers that footers have bounds of."""
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with _microseconds(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(df: DataFrame, rows: int | None = None) -> int:
    """Tasks for a shuffle of ``df``: by its estimated bytes, or by ``rows`` where no estimate is
    worth its name."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // TASK_BYTES) if size < 1 << 60 else -(-(rows or 0) // 100_000)
    return max(df.sparkSession.sparkContext.defaultParallelism, min(wanted, 1_000_000))


def _starts(spark: SparkSession, keys: DataFrame, rows: int, staging: str, seen: dict[str, Column]) -> tuple[dict, dict[int, list]]:
    """keys: ``pos, k``. What ``seen`` observes, and by position the keys of every ``rows``-th row in
    order, the first included.

    Keys are sorted by ranges and stored, so that a key's rank is its file's offset plus its index
    there; no window gathers a position's keys in one task. The driver sees one row per file.
    """
    watched, path = Observation(), f"{staging}/keys-{uuid.uuid4().hex}"
    sorted_ = keys.repartitionByRange(_tasks(keys), "pos", "k").sortWithinPartitions("pos", "k")
    stored = _stored(sorted_.observe(watched, *[c.alias(n) for n, c in seen.items()]).select("pos", "k"), path)
    placed = stored.select("pos", "k", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before: dict[int, int] = {}
    bases = []
    for r in sorted(placed.groupBy("pos", "file").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect(), key=lambda r: (r.pos, r.file)):
        at = before.get(r.pos, 0)
        bases.append((r.pos, r.file, at - r.first))
        before[r.pos] = at + r.n
    firsts: dict[int, list] = {}
    if bases:
        base = F.broadcast(spark.createDataFrame(bases, "pos long, file string, base long"))
        found = placed.join(base, ["pos", "file"]).where((F.col("row") + F.col("base")) % rows == 0).select("pos", "k").toArrow().to_pylist()
        for r in sorted(found, key=lambda r: (r["pos"], r["k"])):
            firsts.setdefault(r["pos"], []).append(r["k"])
    return watched.get, firsts


def _write_groups(table: KeyedTable, tagged: DataFrame, groups: list[_Group], staging: str, options: WriteOptions, rows: int, merge: bool, mean_bytes: int = 1 << 30, never: frozenset[str] = frozenset(), repeats: bool = False) -> tuple[dict, list[tuple[int, Block]]]:
    """Write ``row, k, op`` in files of ``rows``, each group by itself and sorted by key. What was
    observed, and (position, block) of each file in order, whose rows are held against it.

    One shuffle deals groups to tasks by their rows, one sort brings a task's groups and their keys in
    order, and the writer begins a file with each group and after so many rows. merge: a base
    row (no op) whose key has an op too goes, and so do deletes. never: columns to be declared never
    null; all others can be, whatever their source says. repeats: a file holds ``rows`` different keys
    with all their rows, whose count nothing else bounds.
    """
    spark = table.spark
    if not groups:
        return {"rows": 0, "keys": None, "added": 0, "updated": 0, "deleted": 0}, []
    tasks, total = min(len(groups), _tasks(tagged, sum(g.rows for g in groups))), sum(g.rows for g in groups) or 1
    codes, passed = [], 0
    for i, g in enumerate(groups):
        codes.append(min(tasks - 1, passed * tasks // total) << 32 | i)
        passed += g.rows
    below = groups[0].start is None
    starts = [g.start for g in groups[below:]]
    code = last_at_or_below(spark, F.col("k"), table.key_type, starts, codes=codes if below else [codes[0], *codes])
    maybe = F.when(F.col("code") >= 0, F.col("row")).alias("row")  # always so, but its fields become nullable
    dealt = tagged.withColumn("code", code).select(maybe, "k", "op", F.shiftright("code", 32).cast("int").alias("task"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("part"))
    dealt = dealt.repartitionById(tasks, "task").sortWithinPartitions("task", "part", "k")
    watched, isbase = Observation(), F.col("op").isNull()
    if merge:
        dealt = dealt.withColumn("by", F.max("op").over(Window.partitionBy("task", "part", "k")))
        stays = F.when(isbase, F.col("by").isNull()).otherwise(F.col("op") == UPSERT)
        seen = {"rows": stays, "added": F.col("op") == UPSERT, "updated": isbase & (F.col("by") == UPSERT), "deleted": isbase & (F.col("by") == DELETE)}
        dealt = dealt.observe(watched, *[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in seen.items()]).where(stays)
    else:
        dealt = dealt.observe(watched, F.count("*").alias("rows"), F.bit_xor(F.xxhash64("k")).alias("keys"))
    if repeats:
        at = F.dense_rank().over(Window.partitionBy("task", "part").orderBy("k")) - 1
        dealt = dealt.withColumn("part", F.col("part").cast("long") * (1 << 32) + F.floor(at / rows))
    limit = 0 if repeats else rows
    key, task, part = free(table.schema.fieldNames(), "k", "task", "part")
    fields = [_set(F.col("row")[f.name], f) if f.name in never else F.col("row")[f.name].alias(f.name) for f in table.schema]
    final = dealt.select(*fields, F.col("k").alias(key), F.col("task").alias(task), F.col("part").alias(part))
    # The rows are in this order already: the planner sees that and sorts once, unless keys repeat.
    final = final.sortWithinPartitions(named(task), named(part), named(key)).drop(key)
    out = f"{staging}/files"
    with _microseconds(spark):
        final.write.options(**options.of_writer(limit or (1 << 31) - 1, mean_bytes)).option("maxRecordsPerFile", limit).partitionBy(task, part).parquet(out)
    found = []
    for block in table._blocks(out):
        at = re.search(rf"/{re.escape(part)}=(\d+)/[^/]*$", block.file)
        found.append((groups[int(at[1]) >> 32 if repeats else int(at[1])].pos, block))
    _in_order([b for _, b in found])
    if sum(b.n_rows for _, b in found) != watched.get["rows"]:
        raise KeyedTableError("the files do not hold all rows")
    return watched.get, found


def _filler(kind: T.DataType) -> Column | None:
    """Some value of a type; None for types that have no plain one."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("") if isinstance(kind, T.StringType) else F.lit(b"")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(datetime.date(1970, 1, 1)).cast(kind)
    return None


def _set(value: Column, field: T.StructField) -> Column:
    """``value`` as never null, an error if it is."""
    given = F.when(value.isNull(), F.raise_error(F.lit(f"{field.name} is declared never null"))).otherwise(value)
    return F.coalesce(given, _filler(field.dataType)).alias(field.name)


class _Staging:
    """A folder beside ``dest`` that becomes ``dest`` by one rename, or goes."""

    def __init__(self, files: Files, dest: str, source: str | None = None):
        if source is not None and (dest == source or dest.startswith(source + "/") or source.startswith(dest + "/")):
            raise KeyedTableError("source and destination must not be or hold one another")
        if files.exists(dest):
            raise KeyedTableError(f"{dest} exists")
        self.files, self.dest, self.path = files, dest, f"{dest}.__staging-{uuid.uuid4().hex}"

    def __enter__(self) -> _Staging:
        self.files.make(f"{self.path}/table")
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.files.delete(self.path)

    def commit(self, wanted: list, schema: T.StructType) -> int:
        """wanted: the files of the new table, as ``place_files`` takes them. The bytes copied."""
        copied = place_files(self.files.spark, wanted)
        if not wanted:  # an empty table keeps its schema
            self.files.spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{self.path}/empty")
            self.files.rename(self.files.list(f"{self.path}/empty")[0][0], f"{self.path}/table/{_part(0)}")
        self.files.touch(f"{self.path}/table/_SUCCESS")
        self.files.rename(f"{self.path}/table", self.dest)
        return copied
