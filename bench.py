"""Headline timings, as one JSON line: keyed rewrites by share of touched blocks, block size and codec,
each against a rewrite of every block, then reads.

The table holds all orders, each with a stretch of a document as its payload: at sf0.1, 150,000 records
of about 2,800 bytes. A rewrite's time is the lesser of two runs.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from keyloom.operators.mutations import Mutations  # noqa: E402
from keyloom.operators.table import KeyedTable, WriteOptions  # noqa: E402

PAYLOAD = 2700
#: rows of a block, codec, percentages of blocks touched.
CASES = ((100, "snappy", (1, 10)), (1000, "snappy", (0, 1, 10, 50, 100)), (10_000, "none", (10, 50, 100)), (10_000, "snappy", (10, 50, 100)), (10_000, "gzip", (10, 50, 100)), (100_000, "snappy", (50, 100)))


def records(spark: SparkSession, sf: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") >= PAYLOAD)
    n = texts.count()
    numbered = texts.select((F.row_number().over(Window.orderBy("doc_id")) - 1).alias("at"), F.substring("text", 1, PAYLOAD).alias("payload"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.withColumn("at", F.col("o_orderkey") % n).join(F.broadcast(numbered), "at").drop("at")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work, took = tempfile.mkdtemp(prefix="keyloom-bench-"), {}

    def timed(name: str, f):
        start = time.perf_counter()
        out = f()
        took[name] = min(took.get(name, 1e9), round(time.perf_counter() - start, 3))
        return out

    def rewrites(name: str, table: KeyedTable, at: str, options: WriteOptions, percentages: tuple[int, ...]) -> None:
        for _ in range(2):
            for percent in percentages:
                m = touching(table, percent)
                timed(f"{name}_{percent}pct", lambda: table.rewrite(m, at, options))  # noqa: B023
                shutil.rmtree(at)

    def touching(table: KeyedTable, percent: int) -> Mutations:
        """One update in each of the blocks to touch, spread over the table."""
        n = table.block_count
        chosen = [table.blocks[i].key_min for i in range(n) if (i + 1) * percent // 100 > i * percent // 100] or [b.key_min for b in table.blocks[: min(1, percent)]]
        return Mutations.upserts(rows.where(F.col("o_orderkey").isin(chosen)).withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey")

    try:
        records(spark, sf).write.parquet(f"{work}/source")
        rows = spark.read.parquet(f"{work}/source")
        warm = KeyedTable.create(spark, rows.limit(5000), f"{work}/warm", "o_orderkey", WriteOptions(1000))
        warm.rewrite(touching(warm, 50), f"{work}/warm2")
        for size, codec, percentages in CASES:
            at, options = f"{work}/{size}-{codec}", WriteOptions(size, compression=codec)
            table = timed(f"create_{size}_{codec}", lambda: KeyedTable.create(spark, rows, at, "o_orderkey", options))  # noqa: B023
            rewrites(f"rewrite_{size}_{codec}", table, f"{at}-new", options, percentages)
        timed("scan", lambda: table.scan().agg(F.sum("o_totalprice")).collect())
        timed("lookup", lambda: table.lookup(table.blocks[-1].key_min).collect())
        timed("rechunk", lambda: table.rechunk(f"{work}/re", 2500))
        big = KeyedTable.create(spark, rows, f"{work}/groups", "o_orderkey", WriteOptions(50_000, group_rows=1000))
        big = KeyedTable.open(spark, big.path, "o_orderkey", row_groups=True)
        rewrites("rewrite_row_groups", big, f"{work}/groups-new", WriteOptions(1000), (1, 50, 100))
    finally:
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "keyed_rewrite_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("/sf")[2]}))


if __name__ == "__main__":
    main()
