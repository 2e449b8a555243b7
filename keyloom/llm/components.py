"""Connected components by alternating stars, for links that do not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_key, materialize


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _with_least(links: DataFrame, label: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``links`` with ``m``, the smallest b of its a; and the stored table that it is read from."""
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), label)
    return joined_by_key(links, least, "a", "n", total), least


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, on the smallest node known, until
    the links are stars around the roots: about log(n) rounds. Minima are aggregated before
    the shuffle; nodes of very many links get theirs without one. Every round is written to the
    shared folder, and the one before deleted. Links with a null end or of a node to itself count
    for nothing; a node without links is not in the result.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, label)
    state = _state(e)
    while state[0]:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near, least = _with_least(both, label, 2 * state[0])
        large = materialize(near.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), label)
        star, low = _with_least(large, label, 2 * state[0])
        star = star.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        before, e = e, materialize(star.select("x.*").where("a <> b").distinct(), label)
        for done in (before, least, large, low):
            discard(done)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
