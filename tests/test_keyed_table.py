"""Keyed tables: the reference scenarios, layout against the closed form, audits and errors."""

import datetime
import decimal
import hashlib
import math
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.functions.checks import KeyedTableError
from keyloom.operators.mutations import Mutations
from keyloom.operators.table import KeyedTable, WriteOptions
from keyloom.plans.positions import positions
from keyloom.streaming.apply import apply_stream


def values(ids, tag="a"):
    return [(str(i), f"{tag}{i}".encode()) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, value binary")


def local(uri):
    return uri.removeprefix("file:")


def digests(table):
    return {hashlib.sha256(open(local(f), "rb").read()).hexdigest() for f, _ in table.listed}


SCENARIOS = {
    "deletion": (range(1, 999), -1, [("D", i) for i in (1, 50, 999)], 996),
    "insert": (range(100, 999), -1, [("U", i) for i in (0, 1, 10000, 5000, 9999)], 904),
    "combo": (range(100, 999), 64, [("D", i) for i in (100, 200, 300, 500)] + [("U", i) for i in (0, 1, 400, 501, 502, 5000, 9999, 10000)], 900),
    "no_changes": (range(100, 999), 64, [], 899),
    "large": (range(100, 99999), 100, [("D" if i % 2 == 0 else "U", i) for i in range(99999)], 49999),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, tmp_path, name):
    ids, group, ops, count = SCENARIOS[name]
    table = KeyedTable.create(spark, frame(spark, values(ids)), f"{tmp_path}/a", "key", WriteOptions(group if group > 0 else 100))
    m = spark.createDataFrame([(str(i), f"b{i}".encode() if op == "U" else None, op) for op, i in ops], "key string, value binary, op string")
    out, report = table.rewrite(Mutations.from_ops(m, "key"), f"{tmp_path}/b", WriteOptions(group))
    want = dict(values(ids))
    for op, i in ops:
        if op == "U":
            want[str(i)] = f"b{i}".encode()
        else:
            want.pop(str(i), None)
    rows = [(r.key, bytes(r.value)) for r in out.scan(ordered=True).collect()]
    assert rows == sorted(want.items()) and len(rows) == count == report.rows_out
    assert out.unsorted_rows().count() == 0 and out.duplicate_keys().count() == 0 and out.overlaps().count() == 0
    assert len(digests(table) & digests(out)) >= report.raw_blocks == table.block_count - report.merged_blocks
    assert report.bytes_copied == sum(b.n_bytes for b in table.plan(Mutations.from_ops(m, "key").checked(table.schema)).raw)


def closed_form(blocks, ups, dels, size):
    """Blocks as lists of keys; the lists of keys of the output, in order, and whether copied."""
    def pos(k):
        return max((i for i, b in enumerate(blocks) if b[0] <= k), default=-1)

    dirty = {pos(k) for k in [*ups, *dels] if pos(k) >= 0 and k <= blocks[pos(k)][-1]}
    out = []
    for p in range(-1, len(blocks)):
        added = [k for k in ups if pos(k) == p]
        rows = added
        if p >= 0 and p not in dirty:
            out.append((blocks[p], True))
        elif p >= 0:
            rows = [k for k in blocks[p] if k not in ups and k not in dels] + added
        rows = sorted(rows)
        out += [(rows[i : i + size], False) for i in range(0, len(rows), size)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_layout_is_the_closed_form(spark, tmp_path, seed):
    r = random.Random(seed)
    keys = sorted(r.sample(range(400), 120))
    touched = r.sample(range(-20, 430), r.choice([0, 3, 12, 60]))
    ups = [k for k in touched if r.random() < 0.5]
    dels = [k for k in touched if k not in ups]
    size = 10
    table = KeyedTable.create(spark, spark.createDataFrame([(k, 0) for k in keys], "key long, v int"), f"{tmp_path}/a", "key", WriteOptions(size))
    m = Mutations.upserts(spark.createDataFrame([(k, 1) for k in ups], "key long, v int"), "key").and_(Mutations.deletes(spark.createDataFrame([(k,) for k in dels], "key long"), "key"))
    out, report = table.rewrite(m, f"{tmp_path}/b", WriteOptions(size))
    want = closed_form([keys[i : i + size] for i in range(0, len(keys), size)], ups, dels, size)
    assert [(b.n_rows, b.key_min, b.key_max) for b in out.blocks] == [(len(rows), rows[0], rows[-1]) for rows, _ in want]
    raw = [open(local(f.file), "rb").read() for f, (_, c) in zip(out.blocks, want, strict=True) if c]
    assert report.raw_blocks == len(raw) and {hashlib.sha256(x).hexdigest() for x in raw} <= digests(table)
    assert {r.key: r.v for r in out.scan().collect()} == {k: int(k in ups) for rows, _ in want for k in rows}
    assert (report.inserted, report.updated, report.deleted, report.absent_deletes) == (len(set(ups) - set(keys)), len(set(ups) & set(keys)), len(set(dels) & set(keys)), len(set(dels) - set(keys)))


@pytest.mark.parametrize("kind", ["long", "string", "date", "decimal(9,2)"])
def test_positions(spark, kind):
    r = random.Random(1)
    def turn(i):
        return {"long": i, "string": f"{i:05}é", "date": datetime.date(2000, 1, 1) + datetime.timedelta(i), "decimal(9,2)": decimal.Decimal(i)}[kind]

    edges = sorted(r.sample(range(10, 10_000), 600))
    lows, highs = edges[::2], edges[1::2]
    keys = [*r.sample(range(10_010), 2000), *lows, *highs]
    want = []
    for k in keys:
        at = max((i for i, b in enumerate(lows) if b <= k), default=-1)
        want.append((turn(k), at, at >= 0 and k <= highs[at]))
    df = spark.createDataFrame([(turn(k),) for k in keys], f"key {kind}")
    for few in (1000, 7):
        got = positions(df, F.col("key"), df.schema[0].dataType, [turn(i) for i in lows], [turn(i) for i in highs], few=few)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_all_types_survive(spark, tmp_path):
    schema = "key string, b binary, i int, l long, t boolean, f float, d double, dec decimal(12,3), ts timestamp, ntz timestamp_ntz, s struct<a: int, n: struct<x: string>>, arr array<int>, m map<string, int>"
    now = datetime.datetime(2020, 1, 2, 3, 4, 5, 678)
    rows = [(f"k{i:03}", b"\0\xff", i, i << 40, i % 2 == 0, 0.5, math.nan, decimal.Decimal("1.125"), now, now, (i, ("x",)), [i, None], {"a": i}) for i in range(50)] + [("z", *[None] * 12)]
    df = spark.createDataFrame(rows, schema)
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(20, group_rows=7))
    out, _ = table.rewrite(Mutations.deletes(df.where("key = 'k010'"), "key"), f"{tmp_path}/b")
    assert out.schema == table.schema and sorted(map(repr, out.scan().collect())) == sorted(repr(r) for r in df.where("key <> 'k010'").collect())
    assert [r.n_rows for r in table.block_stats().orderBy("file", "block").collect()] == [7, 7, 6, 7, 7, 6, 7, 4]


def test_nested_key_and_other_letters(spark, tmp_path):
    df = spark.createDataFrame([((k,), i) for i, k in enumerate(["", "a", "z", "é", "～", "😀"])], "id struct<k: string>, v int")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "id.k", WriteOptions(2))
    assert [(b.key_min, b.key_max) for b in table.blocks] == [("", "a"), ("z", "é"), ("～", "😀")]
    assert table.lookup("é").first().v == 3


def test_empty_tables(spark, tmp_path):
    empty = frame(spark, [])
    table = KeyedTable.create(spark, empty, f"{tmp_path}/a", "key")
    assert table.block_count == 0 and table.scan().count() == 0 and table.schema == empty.schema
    out, report = table.rewrite(Mutations.upserts(frame(spark, values(range(5))), "key"), f"{tmp_path}/b")
    assert report.inserted == 5 and out.scan().count() == 5
    gone, report = out.rewrite(Mutations.deletes(frame(spark, values(range(5))), "key"), f"{tmp_path}/c")
    assert gone.scan().count() == 0 and gone.block_count == 0 and report.files_out == 0


def test_rechunk_and_force(spark, tmp_path):
    table = KeyedTable.create(spark, frame(spark, values(range(1000, 1250))), f"{tmp_path}/a", "key", WriteOptions(100))
    assert [b.n_rows for b in table.rechunk(f"{tmp_path}/b", 40).blocks] == [40, 40, 20, 40, 40, 20, 40, 10]
    assert [b.n_rows for b in table.rechunk(f"{tmp_path}/c", 120, coalesce=True).blocks] == [120, 120, 10]
    out, report = table.rewrite(Mutations.upserts(frame(spark, []), "key"), f"{tmp_path}/d", force=(1,))
    assert (report.raw_blocks, report.merged_blocks) == (2, 1) and out.scan().count() == 250
    with pytest.raises(KeyedTableError, match="no block"):
        table.plan(Mutations.upserts(frame(spark, []), "key"), force=(9,))
    assert table.default_sizing().first() == (83, table.block_stats().agg({"n_bytes": "avg"}).first()[0] // 1)


def test_mixed_codecs_read_together(spark, tmp_path):
    table = KeyedTable.create(spark, frame(spark, values(range(1000, 1300))), f"{tmp_path}/a", "key", WriteOptions(100))
    out, _ = table.rewrite(Mutations.deletes(frame(spark, values([1005])), "key"), f"{tmp_path}/b", WriteOptions(100, compression="gzip", dictionary=False, page_bytes=4096, dictionary_page_bytes=4096))
    assert {r.codec for r in out.block_stats().collect()} == {"GZIP", "SNAPPY"} and out.scan().count() == 299


def test_errors(spark, tmp_path):
    rows = frame(spark, values(range(100, 200)))
    table = KeyedTable.create(spark, rows, f"{tmp_path}/a", "key", WriteOptions(50))
    twice = frame(spark, [("1", b"x"), ("1", b"y")])
    some = Mutations.upserts(frame(spark, [("1", b"x")]), "key")
    for bad, said in (
        (Mutations.upserts(twice, "key"), "2 times"),
        (some.and_(Mutations.deletes(twice.limit(1), "key")), "2 times"),
        (Mutations.upserts(frame(spark, [(None, b"x")]), "key"), "null"),
        (Mutations.upserts(twice.limit(1).withColumn("more", F.lit(1)), "key"), "columns"),
        (Mutations.upserts(twice.limit(1).withColumn("value", F.lit(1)), "key"), "columns"),
    ):
        with pytest.raises(KeyedTableError, match=said):
            table.rewrite(bad, f"{tmp_path}/x")
    with pytest.raises(Exception, match="unknown operation"):
        table.rewrite(Mutations.from_ops(twice.limit(1).withColumn("op", F.lit("X")), "key"), f"{tmp_path}/x")
    for dest in (f"{tmp_path}/a", f"{tmp_path}/a/in", str(tmp_path)):
        with pytest.raises(KeyedTableError):
            table.rewrite(some, dest)
    with pytest.raises(KeyedTableError, match="more than once"):
        KeyedTable.create(spark, twice, f"{tmp_path}/x", "key")
    with pytest.raises(KeyedTableError, match="null"):
        KeyedTable.create(spark, frame(spark, [(None, b"x")]), f"{tmp_path}/x", "key")
    with pytest.raises(KeyedTableError, match="NaN"):
        KeyedTable.create(spark, spark.createDataFrame([(math.nan,)], "key double"), f"{tmp_path}/x", "key")
    with pytest.raises(KeyedTableError, match="no table"):
        KeyedTable.open(spark, f"{tmp_path}/none", "key")
    with pytest.raises(KeyedTableError):
        WriteOptions(0)
    assert sorted(os.listdir(tmp_path)) == ["a"]


def test_audits(spark, tmp_path):
    for i, ids in enumerate(([1, 3, 2], [3, 9], [20, 30])):
        spark.createDataFrame([(k,) for k in ids], "key long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    with pytest.raises(KeyedTableError, match="overlap"):
        KeyedTable.open(spark, f"{tmp_path}/a", "key")
    table = KeyedTable.open(spark, f"{tmp_path}/a", "key", validate=False)
    assert [tuple(r) for r in table.duplicate_keys().collect()] == [(3, 2)]
    assert [(r.key, r.previous) for r in table.unsorted_rows().collect()] == [(2, 3)]
    assert [(r.key_min, r.reach) for r in table.overlaps().collect()] == [(3, 3)]
    assert table.bad_keys().count() == 0


def test_missing_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "a")
    pq.write_table(pa.table({"key": [1, 2, 3]}), tmp_path / "a/x.parquet", write_statistics=False)
    with pytest.raises(KeyedTableError, match="no statistics"):
        KeyedTable.open(spark, f"{tmp_path}/a", "key")
    table = KeyedTable.open(spark, f"{tmp_path}/a", "key", compute_stats=True)
    assert [(b.n_rows, b.key_min, b.key_max) for b in table.blocks] == [(3, 1, 3)]


def test_stream(spark, tmp_path):
    schema = "key string, value binary, op string, at int"
    KeyedTable.create(spark, frame(spark, values(range(100, 160))), f"{tmp_path}/t/v0", "key", WriteOptions(20))
    for i, rows in enumerate(([("100", b"new", "U", 1), ("100", b"newer", "U", 2), ("101", None, "D", 1)], [("999", b"x", "U", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        apply_stream(spark, changes, f"{tmp_path}/t", "key", f"{tmp_path}/check", order="at", trigger={"availableNow": True}).awaitTermination()
    got = {r.key: bytes(r.value) for r in KeyedTable.open(spark, f"{tmp_path}/t/v2", "key").scan().collect()}
    assert got["100"] == b"newer" and "101" not in got and got["999"] == b"x" and len(got) == 60


def test_plans_prune(spark, tmp_path):
    table = KeyedTable.create(spark, spark.createDataFrame([(i, str(i)) for i in range(300)], "key long, v string"), f"{tmp_path}/a", "key", WriteOptions(100))
    plan = table.lookup(5).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,5)]" in plan and "ReadSchema: struct<key:bigint,v:string>" in plan


#: Names that the engine uses inside, and some that are hard to quote.
HOSTILE = "_pos _op _k _inside _code row k op pos inside task part chunk by code file block bound high stretch _name _row _chunk base n rows at in cell _cell before previous _n last first _part=1 a.b back`tick".split()


def test_no_column_name_is_taken(spark, tmp_path):
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in HOSTILE)
    df = spark.createDataFrame([(i, *[f"{c}{i}" for c in HOSTILE]) for i in range(60)], f"id long, {schema}")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "id", WriteOptions(10))
    assert table.scan().columns == df.columns
    ups = df.where("id in (3, 4, 59)").unionByName(df.where("id < 5").withColumn("id", F.col("id") + 100)).withColumn("_op", F.lit("new"))
    m = Mutations.upserts(ups, "id").and_(Mutations.deletes(df.where("id = 30"), "id"))
    assert set(table.plan(m).dirty) == {0, 3, 5}
    out, report = table.rewrite(m, f"{tmp_path}/b")
    assert out.scan().columns == df.columns and (report.inserted, report.updated, report.deleted) == (5, 3, 1)
    want = {tuple(r) for r in df.collect() if r.id not in (3, 4, 30, 59)} | {tuple(r) for r in ups.collect()}
    assert {tuple(r) for r in out.scan().collect()} == want
    for coalesce in (False, True):
        assert {tuple(r) for r in out.rechunk(f"{tmp_path}/c{coalesce}", 7, coalesce=coalesce).scan().collect()} == want
    assert out.unsorted_rows().count() == 0 and out.lookup(104).count() == 1
    ops = ups.limit(2).withColumn("what", F.lit("D"))
    assert out.rewrite(Mutations.from_ops(ops, "id", "what"), f"{tmp_path}/d")[1].deleted == 2
    lows, highs = [b.key_min for b in table.blocks], [b.key_max for b in table.blocks]
    far = positions(df, F.col("id"), df.schema["id"].dataType, lows, highs, "_pos2", "_in2", few=2)
    assert far.columns == [*df.columns, "_pos2", "_in2"] and {(r.id, r._pos2) for r in far.collect()} == {(i, i // 10) for i in range(60)}


def test_mutations_are_read_once(spark, tmp_path):
    """A source that reads differently each time cannot break the key or the report."""
    df = spark.range(400).selectExpr("id as key", "id as v")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(20))
    reads = spark.sparkContext.accumulator(0)

    def some(batches):
        reads.add(1)
        for batch in batches:
            yield batch.filter(pa.array([os.urandom(1)[0] < 128 for _ in range(len(batch))], pa.bool_()))

    unsteady = df.coalesce(1).mapInArrow(some, "key long, v long").withColumn("v", F.lit(-1).cast("long"))
    out, report = table.rewrite(Mutations.upserts(unsteady, "key"), f"{tmp_path}/b")
    rows = out.scan().collect()
    assert sorted(r.key for r in rows) == list(range(400)) and report.rows_out == 400 and report.inserted == 0
    assert report.updated == sum(r.v == -1 for r in rows) and reads.value == 1
    with pytest.raises(KeyedTableError, match="other keys"):
        KeyedTable.create(spark, df.mapInArrow(some, df.schema), f"{tmp_path}/c", "key")
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_timestamps_and_long_texts_as_keys(spark, tmp_path):
    start = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(start + datetime.timedelta(hours=i), i) for i in range(50)], "at timestamp, v int")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "at", WriteOptions(10))
    opened = KeyedTable.open(spark, f"{tmp_path}/a", "at")
    assert opened.block_count == 5 and opened.lookup(start + datetime.timedelta(hours=7)).first().v == 7
    out, report = opened.rewrite(Mutations.deletes(df.where("v = 33"), "at"), f"{tmp_path}/b")
    assert (report.merged_blocks, report.deleted, out.scan().count()) == (1, 1, 49) and table.block_count == 5
    long = spark.createDataFrame([("x" * 5000 + f"{i:03}", i) for i in range(50)], "key string, v int")
    table = KeyedTable.create(spark, long, f"{tmp_path}/c", "key", WriteOptions(10))
    out, report = table.rewrite(Mutations.deletes(long.where("v = 33"), "key"), f"{tmp_path}/d")
    assert (report.merged_blocks, report.deleted, out.scan().count()) == (1, 1, 49)
    assert out.rewrite(Mutations.deletes(long.where("v = 34"), "key"), f"{tmp_path}/e")[1].deleted == 1


def group_bytes(path):
    """The bytes of each row group of a file."""
    import pyarrow.parquet as pq

    data, meta = open(path, "rb").read(), pq.ParquetFile(path).metadata
    out = []
    for g in range(meta.num_row_groups):
        columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
        out.append(b"".join(data[(at := c.dictionary_page_offset or c.data_page_offset) : at + c.total_compressed_size] for c in columns))
    return out


@pytest.mark.parametrize("codec", ["snappy", "gzip"])
def test_row_groups_are_copied_raw(spark, tmp_path, codec):
    df = spark.range(1000).selectExpr("id * 2 as key", "repeat(cast(id as string), 5) as v", "array(id, null) as a", "named_struct('x', nullif(id, 3)) as s")
    made = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(400, group_rows=50, compression=codec))
    table = KeyedTable.open(spark, f"{tmp_path}/a", "key", row_groups=True)
    assert table.block_count == 20 and made.block_count == 3
    ups = df.where("key in (10, 900)").withColumn("v", F.lit("new")).unionByName(df.where("key = 0").withColumn("key", F.lit(-5).cast("long"))).unionByName(df.where("key < 8").withColumn("key", F.col("key") + 99_999))
    dels = df.where("key between 300 and 398")  # a whole group
    out, report = table.rewrite(Mutations.upserts(ups, "key").and_(Mutations.deletes(dels, "key")), f"{tmp_path}/b")
    want = {r.key: tuple(r) for r in df.collect() if not 300 <= r.key <= 398} | {r.key: tuple(r) for r in ups.collect()}
    assert {r.key: tuple(r) for r in out.scan().collect()} == want and out.scan().count() == len(want)
    assert (report.raw_blocks, report.merged_blocks, report.new_fragments, report.rows_out) == (17, 3, 2, len(want)) and report.files_out == 3
    old, new = ([local(f) for f, _ in t.listed] for t in (table, out))
    before, after = [g for f in old for g in group_bytes(f)], [g for f in new for g in group_bytes(f)]
    assert len(set(before) & set(after)) == 17 and report.bytes_copied == sum(len(g) for i, g in enumerate(before) if i not in (0, 3, 9))
    assert [(b.key_min, b.key_max) for b in KeyedTable.open(spark, f"{tmp_path}/b", "key", row_groups=True).blocks][:2] == [(-5, -5), (0, 98)]
    again, _ = out.rewrite(Mutations.deletes(df.where("key = 900"), "key"), f"{tmp_path}/c")
    assert again.scan().count() == len(want) - 1 and out.unsorted_rows().count() == 0
    same = [f for f in new if open(f, "rb").read() in {open(local(g), "rb").read() for g, _ in again.listed}]
    assert len(same) == 2  # files without a dirty group are copied whole


@pytest.mark.parametrize("inside", [False, True])
def test_row_groups_of_columns_that_are_never_null(spark, tmp_path, inside):
    """New groups are declared as those beside them are; where that cannot be, the file is merged."""
    import pyarrow.parquet as pq

    kind = pa.struct([pa.field("x", pa.int64(), nullable=not inside)])
    schema = pa.schema([pa.field("key", pa.int64(), nullable=False), pa.field("v", pa.string(), nullable=False), pa.field("s", kind), pa.field("t", pa.timestamp("us", tz="UTC"), nullable=False)])
    os.makedirs(tmp_path / "a")
    for i in range(2):
        keys = list(range(i * 1000, i * 1000 + 300))
        rows = pa.table({"key": keys, "v": [f"v{k}" for k in keys], "s": [{"x": k} for k in keys], "t": [datetime.datetime(2020, 1, 1)] * 300}, schema=schema)
        pq.write_table(rows, tmp_path / f"a/{i}.parquet", row_group_size=100)
    table = KeyedTable.open(spark, f"{tmp_path}/a", "key", row_groups=True)
    ups = table.scan().where("key in (5, 250)").withColumn("v", F.lit("new"))
    out, report = table.rewrite(Mutations.upserts(ups, "key"), f"{tmp_path}/b")
    want = {r.key: "new" if r.key in (5, 250) else r.v for r in table.scan().collect()}
    assert {r.key: r.v for r in out.scan().collect()} == want and out.scan().where("s.x is null or t is null").count() == 0
    assert (report.raw_blocks, report.merged_blocks) == ((3, 3) if inside else (4, 2))
    assert {pq.read_schema(local(f)).field("v").nullable for f, _ in out.listed} == ({True, False} if inside else {False})
    if not inside:
        with pytest.raises(Exception, match="never null"):
            table.rewrite(Mutations.upserts(ups.withColumn("v", F.lit(None).cast("string")), "key"), f"{tmp_path}/c")


def test_a_load_behind_the_last_block(spark, tmp_path, monkeypatch):
    """Many rows of one position are cut by several tasks, into the same files."""
    from keyloom.operators import table as module

    df = spark.range(1000).selectExpr("id as key", "id as v")
    ups = spark.range(500, 6000).selectExpr("id as key", "-id as v")
    dels = spark.range(990, 995).selectExpr("id as key")
    m = Mutations.upserts(ups.where("key not between 990 and 994"), "key").and_(Mutations.deletes(dels, "key"))
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(250))
    found = []
    for heavy in (1_000_000, 100):
        monkeypatch.setattr(module, "HEAVY_ROWS", heavy)
        out, report = table.rewrite(m, f"{tmp_path}/{heavy}", WriteOptions(100))
        assert (report.updated, report.deleted, report.inserted) == (495, 5, 5000)
        found.append([(b.n_rows, b.key_min, b.key_max) for b in out.blocks])
        assert {(r.key, r.v) for r in out.scan().collect()} == {(i, i if i < 500 else -i) for i in range(6000) if not 990 <= i <= 994}
    assert found[0] == found[1] and max(n for n, _, _ in found[0]) <= 250


def test_lookups_open_the_files_that_can_hold_the_key(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 10 as key", "id as v")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(100))
    assert len(table.lookup(5550).inputFiles()) == 1 and table.lookup(5550).first().v == 555
    assert table.lookup(5555).count() == 0 and len(table.lookup(995).inputFiles()) == 0 and table.lookup(-1).columns == ["key", "v"]
    assert len(table.between(900, 2100).inputFiles()) == 3 and table.between(900, 2100).count() == 121
    assert table.between(-5, 99_999).count() == 1000 and table.between(5, 4).count() == 0


def test_writer_settings(spark, tmp_path):
    df = spark.range(5000).selectExpr("id as key", "repeat(cast(id as string), 20) as v")
    small = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(5000, block_bytes=10_000, page_bytes=2000, dictionary=False, page_rows=(10, 50), page_estimate=False, writer_version="v2", max_padding=0))
    assert small.block_stats().count() > 1 and small.scan().count() == 5000
    plain = KeyedTable.create(spark, df, f"{tmp_path}/b", "key", WriteOptions(5000))
    assert plain.block_stats().count() == 1
    out, _ = small.rewrite(Mutations.deletes(df.where("key = 7"), "key"), f"{tmp_path}/c", WriteOptions(5000, block_bytes=-1))
    assert out.scan().count() == 4999


def test_a_damaged_splice_is_an_error(spark, tmp_path):
    from keyloom.sources.splice import splice

    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.range(10).selectExpr("cast(id as string) as id").coalesce(1).write.parquet(f"{tmp_path}/b")
    a, b = (f"file:{tmp_path}/{x}/{next(n for n in os.listdir(tmp_path / x) if n.startswith('part'))}" for x in "ab")
    with pytest.raises(ValueError, match="schema"):
        splice([(a, None), (b, None)], f"file:{tmp_path}/x.parquet")
    splice([(a, None), (a, 0)], f"file:{tmp_path}/y.parquet")
    assert spark.read.parquet(f"{tmp_path}/y.parquet").count() == 20
    assert not [n for n in os.listdir(tmp_path) if "x.parquet" in n]


def test_rows_move_and_are_sorted_once(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as key", "id as v")
    table = KeyedTable.create(spark, df, f"{tmp_path}/a", "key", WriteOptions(500))
    out, _ = table.rewrite(Mutations.upserts(df.where("key % 700 = 7"), "key"), f"{tmp_path}/b", WriteOptions(150))
    assert [b.n_rows for b in out.blocks[:4]] == [150, 150, 150, 50] and out.unsorted_rows().count() == 0
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    plan = next(p for p in reversed(plans) if "InsertIntoHadoopFsRelationCommand" in p and "Window" in p).split("== Initial Plan ==")[0]
    tree = plan.split("\n\n\n")[0]
    assert len(re.findall(r"\bSort \(", tree)) == 1 and len(re.findall(r"\bExchange \(", tree)) == 1


@pytest.mark.parametrize("heavy", [200_000, 30])
def test_repeated_keys_of_mutations(spark, tmp_path, monkeypatch, heavy):
    """All upserts of a key stay, a delete beside them does nothing, and no key is in two blocks."""
    monkeypatch.setattr("keyloom.operators.table.HEAVY_ROWS", heavy)
    r = random.Random(heavy)
    base = [(k, "old") for k in range(0, 200, 2)]
    ups = [(r.randrange(-20, 320), f"new{i}") for i in range(150)] + [(99, f"hot{i}") for i in range(25)] + [(r.randrange(1000, 1050), f"tail{i}") for i in range(100)]
    dels = [(r.randrange(0, 320),) for _ in range(60)]
    table = KeyedTable.create(spark, spark.createDataFrame(base, "key long, v string"), f"{tmp_path}/a", "key", WriteOptions(10))
    m = Mutations.upserts(spark.createDataFrame(ups, "key long, v string"), "key").and_(Mutations.deletes(spark.createDataFrame(dels, "key long"), "key"))
    with pytest.raises(KeyedTableError, match="times"):
        table.rewrite(m, f"{tmp_path}/b", WriteOptions(10))
    out, report = table.rewrite(m.repeated(), f"{tmp_path}/b", WriteOptions(10))
    changed = {k for k, _ in [*ups, *[(k, None) for (k,) in dels]]}
    want = sorted([x for x in base if x[0] not in changed] + ups)
    assert sorted(map(tuple, out.scan().collect())) == want
    opened = KeyedTable.open(spark, f"{tmp_path}/b", "key")
    assert [(b.n_rows, b.key_min, b.key_max) for b in opened.blocks] == [(b.n_rows, b.key_min, b.key_max) for b in out.blocks]
    assert sorted(r.v for r in opened.lookup(99).collect()) == sorted(v for k, v in ups if k == 99)
    assert all(b.n_rows <= 10 for b in out.blocks if not b.key_min <= 99 <= b.key_max and len({k for k, _ in want if b.key_min <= k <= b.key_max}) == b.n_rows)
    updated, deleted = len({k for k, _ in base} & {k for k, _ in ups}), len({k for k, _ in base} & changed - {k for k, _ in ups})
    assert (report.rows_out, report.updated, report.deleted, report.inserted) == (len(want), updated, deleted, len(ups) - updated)
    again, _ = out.rewrite(Mutations.deletes(spark.createDataFrame([(99,)], "key long"), "key"), f"{tmp_path}/c", WriteOptions(1000))
    assert sorted(map(tuple, again.scan().collect())) == [x for x in want if x[0] != 99]
    with pytest.raises(KeyedTableError, match="null"):
        table.rewrite(Mutations.upserts(spark.createDataFrame([(None, "x")], "key long, v string"), "key").repeated(), f"{tmp_path}/d")
