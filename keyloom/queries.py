"""One query for each operation of keyed tables, and the same in DuckDB SQL.

Queries run the whole engine on whole tables, in a scratch folder: the table is written in
blocks, changed or re-chunked into a new one, and read back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.checks import overlapping_blocks, repeated_keys, unsorted_rows
from .operators.mutations import Mutations
from .operators.table import KeyedTable, RewriteReport, WriteOptions
from .session import ship_package

ROWS = 1000
GROUP_ROWS = 300
SIZED = WriteOptions(ROWS)


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder, or in a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/keyed-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, key: str, rows: int = ROWS) -> KeyedTable:
    return KeyedTable.create(spark, df, scratch(spark), key, WriteOptions(rows))


# --- orders: a table with gaps, and mutations of every kind ----------------------------------

PRICE = "o_totalprice"


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, their keys moved apart so that multiples of 5 are free."""
    return moved(read(spark, sf_dir, "orders"), "o_orderkey + o_orderkey div 4 + 1")


def changed(df: DataFrame) -> DataFrame:
    return df.withColumns({"o_orderstatus": F.lit("U"), PRICE: F.col(PRICE) + 1000})


def moved(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("o_orderkey", F.expr(key).cast("long"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(base_orders(spark, sf_dir).where("o_orderkey % 11 = 3"))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.where("o_orderkey % 25 = 0").unionByName(moved(orders.where("o_orderkey % 700 = 1"), "-o_orderkey")).unionByName(moved(orders.where("o_orderkey % 300 = 2"), "o_orderkey + 10000000"))


def doomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_orders(spark, sf_dir).where("o_orderkey % 97 = 0 and o_orderkey % 11 <> 3")


def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(read(spark, sf_dir, "orders").where("o_orderkey % 1000 = 1"), "o_orderkey + 20000000").unionByName(read(spark, sf_dir, "orders").where("o_orderkey % 1000 = 5"))


def combo(spark: SparkSession, sf_dir: str) -> Mutations:
    key = "o_orderkey"
    ups = Mutations.upserts(existing(spark, sf_dir).unionByName(fresh(spark, sf_dir)), key)
    # From some 8 million orders on, keys behind the table reach into it.
    return ups.and_(Mutations.deletes(doomed(spark, sf_dir).unionByName(absent(spark, sf_dir)), key)).repeated()


def sparse(spark: SparkSession, sf_dir: str) -> Mutations:
    """Few blocks touched: a stretch of updates, deletes of keys that do not exist, gaps at both ends."""
    orders, key = read(spark, sf_dir, "orders"), "o_orderkey"
    ups = changed(base_orders(spark, sf_dir).where("o_orderkey between 2000 and 2100")).unionByName(moved(orders.where("o_orderkey % 700 = 1"), "-o_orderkey")).unionByName(moved(orders.where("o_orderkey <= 2500"), "o_orderkey + 10000000"))
    return Mutations.upserts(ups, key).and_(Mutations.deletes(orders.where("o_orderkey in (5, 10, 6000) or o_orderkey % 5 = 0 and o_orderkey between 9000 and 9100"), key))


def rewritten(spark: SparkSession, df: DataFrame, mutations: Mutations, options: WriteOptions = SIZED) -> tuple[KeyedTable, RewriteReport]:
    return stored(spark, df, mutations.key).rewrite(mutations, scratch(spark), options)


def _merge(ups: Callable | None, dels: Callable | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, key = base_orders(spark, sf_dir), "o_orderkey"
        m = Mutations.upserts(ups(spark, sf_dir) if ups else base.limit(0), key)
        if dels:
            m = m.and_(Mutations.deletes(dels(spark, sf_dir), key))
        return rewritten(spark, base, m)[0].scan()

    return run


def merge_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, base_orders(spark, sf_dir), combo(spark, sf_dir))[0].scan()


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = doomed(spark, sf_dir).select("o_orderkey")
    return rewritten(spark, base_orders(spark, sf_dir), Mutations.deletes(keys, "o_orderkey"))[0].scan()


def alternate_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    ops = changed(orders).withColumn("op", F.when(F.col("o_orderkey") % 2 == 0, "D").otherwise("U"))
    return rewritten(spark, base_orders(spark, sf_dir), Mutations.from_ops(ops, "o_orderkey"))[0].scan()


def string_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by an expression over the record."""
    by = F.col("o_orderkey").cast("string")

    def some(df: DataFrame) -> DataFrame:
        return df.select("o_orderkey", PRICE)

    m = Mutations.upserts(some(existing(spark, sf_dir).unionByName(fresh(spark, sf_dir))), "k", by).and_(Mutations.deletes(doomed(spark, sf_dir), "k", by)).repeated()
    table = KeyedTable.create(spark, some(base_orders(spark, sf_dir)), scratch(spark), "k", SIZED, by=by)
    return table.rewrite(m, scratch(spark), SIZED)[0].scan().select("k", PRICE)


def nested_payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    ups = df.where("vec_id % 7 = 0").withColumn("embedding", F.reverse("embedding"))
    m = Mutations.upserts(ups, "vec_id").and_(Mutations.deletes(df.where("vec_id % 7 = 1"), "vec_id"))
    table, _ = stored(spark, df, "vec_id", 100).rewrite(m, scratch(spark))
    return table.scan().select("vec_id", F.posexplode("embedding").alias("at", "value"), "label").select("vec_id", "at", F.col("value").cast("double").alias("value"), "label")


def timestamp_payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    ups = df.where("event_id % 13 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    m = Mutations.upserts(ups, "event_id").and_(Mutations.deletes(df.where("event_id % 13 = 1"), "event_id"))
    return rewritten(spark, df, m)[0].scan()


def fully_deleted_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, base_orders(spark, sf_dir), "o_orderkey")
    second = table.blocks[1]
    out, _ = table.rewrite(Mutations.deletes(table.between(second.key_min, second.key_max), "o_orderkey"), scratch(spark), SIZED)
    return spark.createDataFrame([(b.number, b.n_rows, b.key_min, b.key_max) for b in out.blocks], "block long, n_rows long, key_min long, key_max long")


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, base_orders(spark, sf_dir), "o_orderkey")
    return table.block_stats().select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("block"), "n_rows", "key_min", "key_max")


def default_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, base_orders(spark, sf_dir), "o_orderkey").default_sizing().select("avg_rows")


def mutation_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = stored(spark, base_orders(spark, sf_dir), "o_orderkey").plan(combo(spark, sf_dir))
    return plan.placed.select("o_orderkey", F.col("_op").alias("op"), F.col("_pos").alias("pos"), F.col("_inside").alias("inside"))


def dirty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = stored(spark, base_orders(spark, sf_dir), "o_orderkey").plan(sparse(spark, sf_dir))
    return spark.createDataFrame([(b,) for b in sorted(plan.dirty)], "block long")


def force_dirty_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_orders(spark, sf_dir)
    plan = stored(spark, base, "o_orderkey").plan(Mutations.upserts(base.limit(0), "o_orderkey"), force=(1,))
    return plan.layout(spark)


def rewrite_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, base_orders(spark, sf_dir), "o_orderkey").plan(sparse(spark, sf_dir)).layout(spark)


def output_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = rewritten(spark, base_orders(spark, sf_dir), sparse(spark, sf_dir))
    return spark.createDataFrame([(b.number, b.n_rows) for b in table.blocks], "block long, n_rows long")


def _rechunk(rows: int, coalesce: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = stored(spark, base_orders(spark, sf_dir), "o_orderkey").rechunk(scratch(spark), rows, coalesce=coalesce)
        return spark.createDataFrame([(b.number, b.n_rows, b.key_min) for b in table.blocks], "block long, n_rows long, key_min long")

    return run


def key_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, base_orders(spark, sf_dir), "o_orderkey").lookup(4321)


def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, base_orders(spark, sf_dir), "o_orderkey").between(500, 1700)


def duplicate_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_keys(existing(spark, sf_dir).unionByName(base_orders(spark, sf_dir).where("o_orderkey % 33 = 3")), "o_orderkey")


def unsorted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("file"))
    return unsorted_rows(df, "l_orderkey", "file", "row").select("l_orderkey", "row", "previous")


def overlapping_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").withColumn("block", F.floor((F.col("o_orderkey") + 37 * (F.col("o_orderkey") % 3)) / 500).cast("long"))
    stats = df.groupBy("block").agg(F.min("o_orderkey").alias("key_min"), F.max("o_orderkey").alias("key_max"))
    return overlapping_blocks(stats).select("block", "key_min", "key_max", "reach")


def block_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(stored(spark, base_orders(spark, sf_dir), "o_orderkey").block_count,)], "blocks long")


def forced_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_orders(spark, sf_dir)
    out, report = stored(spark, base, "o_orderkey").rewrite(Mutations.upserts(base.limit(0), "o_orderkey"), scratch(spark), SIZED, force=(1,))
    return spark.createDataFrame([(b.number, b.n_rows, report.raw_blocks, report.merged_blocks) for b in out.blocks], "block long, n_rows long, raw_blocks long, merged_blocks long")


def row_groups_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = KeyedTable.create(spark, base_orders(spark, sf_dir), scratch(spark), "o_orderkey", WriteOptions(ROWS, group_rows=GROUP_ROWS))
    return table.block_stats().select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("file"), F.col("block").alias("row_group"), "n_rows", "key_min", "key_max")


def raw_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large files of many row groups; groups without mutations are copied byte for byte."""
    path = scratch(spark)
    KeyedTable.create(spark, base_orders(spark, sf_dir), path, "o_orderkey", WriteOptions(8 * ROWS, group_rows=ROWS))
    table = KeyedTable.open(spark, path, "o_orderkey", row_groups=True)
    out, report = table.rewrite(sparse(spark, sf_dir), scratch(spark), SIZED)
    return spark.createDataFrame([(b.number, b.n_rows, b.key_min, b.key_max, report.raw_blocks) for b in out.blocks], "block long, n_rows long, key_min long, key_max long, raw_blocks long")


def mixed_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = rewritten(spark, base_orders(spark, sf_dir), sparse(spark, sf_dir), WriteOptions(ROWS, compression="gzip"))
    return table.block_stats().groupBy("codec").agg(F.count("*").alias("blocks"), F.sum("n_rows").alias("n_rows"))


_COUNTED = ["rows_in", "rows_out", "inserted", "updated", "deleted", "absent_deletes", "raw_blocks", "merged_blocks", "new_fragments", "files_out"]


def rewrite_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, base_orders(spark, sf_dir), sparse(spark, sf_dir))[1].frame(spark).select(*_COUNTED)


def rewrite_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases of a rewrite with what each dealt with; wall times differ, so only that there are some."""
    report = rewritten(spark, base_orders(spark, sf_dir), sparse(spark, sf_dir))[1]
    phases = [("plan", report.raw_blocks + report.merged_blocks, report.plan_seconds), ("merge", report.merged_blocks, report.merge_seconds), ("commit", report.files_out, report.commit_seconds)]
    return spark.createDataFrame([(p, n, t > 0) for p, n, t in phases], "phase string, blocks long, timed boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merge_combo": merge_combo,
    "upsert_existing": _merge(existing, None),
    "insert_gap_prefix_tail": _merge(fresh, None),
    "delete_by_key": delete_by_key,
    "delete_by_record": _merge(None, doomed),
    "delete_absent": _merge(None, absent),
    "no_change": _merge(None, None),
    "alternate_large": alternate_large,
    "string_key_merge": string_key_merge,
    "nested_payload_merge": nested_payload_merge,
    "timestamp_payload_merge": timestamp_payload_merge,
    "fully_deleted_block": fully_deleted_block,
    "block_stats": block_stats,
    "default_sizing": default_sizing,
    "mutation_position": mutation_position,
    "dirty_blocks": dirty_blocks,
    "force_dirty_block": force_dirty_block,
    "rewrite_layout": rewrite_layout,
    "output_row_groups": output_row_groups,
    "rechunk_split": _rechunk(300, False),
    "rechunk_coalesce": _rechunk(1700, True),
    "key_point_lookup": key_point_lookup,
    "key_range_scan": key_range_scan,
    "duplicate_mutations": duplicate_mutations,
    "unsorted_rows": unsorted_events,
    "overlapping_blocks": overlapping_parts,
    "rewrite_report_counts": rewrite_report_counts,
    "rewrite_timings": rewrite_timings,
    "block_count": block_count,
    "forced_rewrite": forced_rewrite,
    "row_groups_in_files": row_groups_in_files,
    "raw_row_groups": raw_row_groups,
    "mixed_codecs": mixed_codecs,
}


# --- DuckDB ----------------------------------------------------------------------------------

_COLS = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_CHANGED = "o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice + 1000 AS o_totalprice, o_orderdate, o_orderpriority"
_CTES = f"""
base AS (SELECT o_orderkey + o_orderkey // 4 + 1 AS o_orderkey, {_COLS} FROM orders),
existing AS (SELECT {_CHANGED} FROM base WHERE o_orderkey % 11 = 3),
fresh AS (SELECT * FROM orders WHERE o_orderkey % 25 = 0
  UNION ALL SELECT -o_orderkey, {_COLS} FROM orders WHERE o_orderkey % 700 = 1
  UNION ALL SELECT o_orderkey + 10000000, {_COLS} FROM orders WHERE o_orderkey % 300 = 2),
doomed AS (SELECT o_orderkey FROM base WHERE o_orderkey % 97 = 0 AND o_orderkey % 11 <> 3),
absent AS (SELECT o_orderkey + 20000000 AS o_orderkey FROM orders WHERE o_orderkey % 1000 = 1
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 5),
few_ups AS (SELECT {_CHANGED} FROM base WHERE o_orderkey BETWEEN 2000 AND 2100
  UNION ALL SELECT -o_orderkey, {_COLS} FROM orders WHERE o_orderkey % 700 = 1
  UNION ALL SELECT o_orderkey + 10000000, {_COLS} FROM orders WHERE o_orderkey <= 2500),
few_dels AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (5, 10, 6000) OR o_orderkey % 5 = 0 AND o_orderkey BETWEEN 9000 AND 9100),
numbered AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {ROWS} AS block FROM base),
blocks AS (SELECT block, count(*) AS n_rows, min(o_orderkey) AS key_min, max(o_orderkey) AS key_max FROM numbered GROUP BY block),
few AS (SELECT o_orderkey, 'U' AS op FROM few_ups UNION ALL SELECT o_orderkey, 'D' FROM few_dels),
few_placed AS (SELECT few.*, coalesce((SELECT max(block) FROM blocks WHERE key_min <= o_orderkey), -1) AS pos FROM few),
few_at AS (SELECT p.*, coalesce(o_orderkey <= key_max, false) AS inside FROM few_placed p LEFT JOIN blocks ON block = pos),
few_dirty AS (SELECT DISTINCT pos FROM few_at WHERE inside),
few_gaps AS (SELECT DISTINCT pos FROM few_at WHERE op = 'U' AND pos NOT IN (SELECT pos FROM few_dirty)),
few_rows AS (SELECT o_orderkey, block AS pos, CASE WHEN block IN (SELECT pos FROM few_dirty) THEN 1 ELSE 0 END AS kind FROM numbered
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM few)
  UNION ALL SELECT o_orderkey, pos, 1 FROM few_at WHERE op = 'U'),
few_out AS (SELECT o_orderkey, pos, kind, (row_number() OVER (PARTITION BY pos, kind ORDER BY o_orderkey) - 1) // {ROWS} AS chunk FROM few_rows)
"""


def _sql_merge(ups: str | None, dels: str | None) -> str:
    gone = " ".join(f"AND o_orderkey NOT IN (SELECT o_orderkey FROM {x})" for x in (ups, dels) if x)
    return f"WITH {_CTES} SELECT * FROM base WHERE true {gone}" + (f" UNION ALL SELECT * FROM {ups}" if ups else "")


_ALL_UPS = "(SELECT * FROM existing UNION ALL SELECT * FROM fresh)"
_ALL_DELS = "(SELECT * FROM doomed UNION ALL SELECT * FROM absent)"

ORACLE_SQL: dict[str, str] = {
    "merge_combo": _sql_merge(_ALL_UPS, _ALL_DELS),
    "upsert_existing": _sql_merge("existing", None),
    "insert_gap_prefix_tail": _sql_merge("fresh", None),
    "delete_by_key": _sql_merge(None, "doomed"),
    "delete_by_record": _sql_merge(None, "doomed"),
    "delete_absent": _sql_merge(None, "absent"),
    "no_change": _sql_merge(None, None),
    "alternate_large": f"WITH {_CTES} SELECT {_CHANGED} FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "string_key_merge": f"WITH {_CTES}, o AS (SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_ALL_UPS}) AND o_orderkey NOT IN (SELECT o_orderkey FROM doomed) UNION ALL SELECT * FROM {_ALL_UPS}) SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice FROM o",
    "nested_payload_merge": "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_reverse(embedding) ELSE embedding END AS v, label FROM embeddings WHERE vec_id % 7 <> 1) SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, CAST(v[i] AS DOUBLE) AS value, label FROM (SELECT vec_id, v, label, unnest(range(1, len(v) + 1)) AS i FROM e)",
    "timestamp_payload_merge": "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts, user_id, event_type, value, props FROM events WHERE event_id % 13 <> 1",
    "fully_deleted_block": f"WITH {_CTES} SELECT row_number() OVER (ORDER BY block) - 1 AS block, n_rows, key_min, key_max FROM blocks WHERE block <> 1",
    "block_stats": f"WITH {_CTES} SELECT block, n_rows, key_min, key_max FROM blocks",
    "default_sizing": f"WITH {_CTES} SELECT CAST(floor(avg(n_rows)) AS BIGINT) AS avg_rows FROM blocks",
    "mutation_position": f"""WITH {_CTES}, m AS (SELECT o_orderkey, 'U' AS op FROM {_ALL_UPS} UNION ALL SELECT o_orderkey, 'D' FROM {_ALL_DELS}),
        p AS (SELECT m.*, coalesce((SELECT max(block) FROM blocks WHERE key_min <= o_orderkey), -1) AS pos FROM m)
        SELECT o_orderkey, op, pos, coalesce(o_orderkey <= key_max, false) AS inside FROM p LEFT JOIN blocks ON block = pos""",
    "dirty_blocks": f"WITH {_CTES} SELECT pos AS block FROM few_dirty",
    "force_dirty_block": f"WITH {_CTES} SELECT block AS pos, CASE WHEN block = 1 THEN 'MERGED' ELSE 'RAW' END AS kind FROM blocks",
    "rewrite_layout": f"WITH {_CTES} SELECT block AS pos, CASE WHEN block IN (SELECT pos FROM few_dirty) THEN 'MERGED' ELSE 'RAW' END AS kind FROM blocks UNION ALL SELECT pos, 'NEW' FROM few_gaps",
    "output_row_groups": f"WITH {_CTES}, g AS (SELECT pos, kind, chunk, count(*) AS n_rows FROM few_out GROUP BY pos, kind, chunk) SELECT row_number() OVER (ORDER BY pos, kind, chunk) - 1 AS block, n_rows FROM g",
    "rechunk_split": f"WITH {_CTES}, c AS (SELECT *, (row_number() OVER (PARTITION BY block ORDER BY o_orderkey) - 1) // 300 AS chunk FROM numbered), g AS (SELECT block, chunk, count(*) AS n_rows, min(o_orderkey) AS key_min FROM c GROUP BY block, chunk) SELECT row_number() OVER (ORDER BY block, chunk) - 1 AS block, n_rows, key_min FROM g",
    "rechunk_coalesce": f"WITH {_CTES}, c AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1700 AS chunk FROM base) SELECT chunk AS block, count(*) AS n_rows, min(o_orderkey) AS key_min FROM c GROUP BY chunk",
    "key_point_lookup": f"WITH {_CTES} SELECT * FROM base WHERE o_orderkey = 4321",
    "key_range_scan": f"WITH {_CTES} SELECT * FROM base WHERE o_orderkey BETWEEN 500 AND 1700",
    "duplicate_mutations": f"WITH {_CTES} SELECT o_orderkey AS key, count(*) AS n FROM (SELECT o_orderkey FROM existing UNION ALL SELECT o_orderkey FROM base WHERE o_orderkey % 33 = 3) GROUP BY o_orderkey HAVING count(*) > 1",
    "unsorted_rows": "WITH r AS (SELECT l_orderkey, row_number() OVER () - 1 AS row FROM lineitem), p AS (SELECT *, lag(l_orderkey) OVER (ORDER BY row) AS previous FROM r) SELECT l_orderkey, row, previous FROM p WHERE l_orderkey <= previous",
    "overlapping_blocks": """WITH b AS (SELECT (o_orderkey + 37 * (o_orderkey % 3)) // 500 AS block, min(o_orderkey) AS key_min, max(o_orderkey) AS key_max FROM orders GROUP BY 1),
        r AS (SELECT *, max(key_max) OVER (ORDER BY key_min, key_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b) SELECT block, key_min, key_max, reach FROM r WHERE key_min <= reach""",
    "rewrite_report_counts": f"""WITH {_CTES}, h AS (SELECT count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op = 'D') AS deleted FROM few JOIN base USING (o_orderkey)), n AS (SELECT count(*) FILTER (op = 'U') AS ups, count(*) FILTER (op = 'D') AS dels FROM few)
        SELECT (SELECT count(*) FROM base) AS rows_in, (SELECT count(*) FROM few_rows) AS rows_out, ups - updated AS inserted, updated, deleted, dels - deleted AS absent_deletes,
        (SELECT count(*) FROM blocks) - (SELECT count(*) FROM few_dirty) AS raw_blocks, (SELECT count(*) FROM few_dirty) AS merged_blocks, (SELECT count(*) FROM few_gaps) AS new_fragments, (SELECT count(*) FROM (SELECT DISTINCT pos, kind, chunk FROM few_out)) AS files_out FROM h, n""",
    "rewrite_timings": f"""WITH {_CTES} SELECT 'plan' AS phase, (SELECT count(*) FROM blocks) AS blocks, true AS timed UNION ALL SELECT 'merge', (SELECT count(*) FROM few_dirty), true
        UNION ALL SELECT 'commit', (SELECT count(*) FROM (SELECT DISTINCT pos, kind, chunk FROM few_out)), true""",
    "block_count": f"WITH {_CTES} SELECT count(*) AS blocks FROM blocks",
    "forced_rewrite": f"WITH {_CTES} SELECT block, n_rows, (SELECT count(*) FROM blocks) - 1 AS raw_blocks, 1::BIGINT AS merged_blocks FROM blocks",
    "row_groups_in_files": f"WITH {_CTES}, g AS (SELECT block AS file, ((row_number() OVER (PARTITION BY block ORDER BY o_orderkey) - 1) // {GROUP_ROWS}) AS row_group, o_orderkey FROM numbered) SELECT file, row_group, count(*) AS n_rows, min(o_orderkey) AS key_min, max(o_orderkey) AS key_max FROM g GROUP BY file, row_group",
    "raw_row_groups": f"WITH {_CTES}, g AS (SELECT pos, kind, chunk, count(*) AS n_rows, min(o_orderkey) AS key_min, max(o_orderkey) AS key_max FROM few_out GROUP BY pos, kind, chunk) SELECT row_number() OVER (ORDER BY pos, kind, chunk) - 1 AS block, n_rows, key_min, key_max, (SELECT count(*) FROM blocks) - (SELECT count(*) FROM few_dirty) AS raw_blocks FROM g",
    "mixed_codecs": f"WITH {_CTES} SELECT CASE WHEN kind = 0 THEN 'SNAPPY' ELSE 'GZIP' END AS codec, count(DISTINCT (pos, chunk)) AS blocks, count(*) AS n_rows FROM few_out GROUP BY kind",
}
