"""Operator 2: mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, ranked
from .sharding import cells_for, shuffle_order, source_key


def target_words(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; what is cut off goes
    to the others by weight until none is above."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in over]
    return target


def van_der_corput(index: Column) -> Column:
    """The bits of the number mirrored at the binary point: evenly spread at every length."""
    return F.conv(F.rpad(F.reverse(F.bin(index)), 48, "0"), 2, 10).cast("double") / F.lit(float(1 << 48))


def schedule(spark, quotas: list[int], block: int) -> DataFrame:
    """``slot, source, rank``: which source each slot of a mix takes its next block from.

    Slot i falls on the source in whose interval of the cumulative quotas the point i of the
    van der Corput sequence lies; slots are ranked per source. Slots beyond a quota are left
    out, and the few that the discrepancy leaves short are appended, the sources by turns. No two
    blocks share a slot.
    """
    total = sum(quotas)
    slots = -(-total // block)
    edges = [x / total for x in accumulate(quotas)][:-1] if total else []
    point = van_der_corput(F.col("slot"))
    at = F.size(F.filter(F.array(*[F.lit(x) for x in edges]).cast("array<double>"), lambda x: x <= F.col("_u"))) if edges else F.lit(0)
    cut = max(1, slots // cells_for(slots))
    rows = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", point).withColumn("source", at.cast("int"))
    rows = rows.withColumn("_cell", F.floor(F.col("slot") / cut)).drop("_u")
    rows = ranked(rows, ["source"], "_cell", ["slot"], None, "rank").select("slot", "source", "rank")
    need = spark.createDataFrame([(i, -(-q // block)) for i, q in enumerate(quotas)], "source int, need long")
    have = rows.groupBy("source").agg(F.count("*").alias("have"))
    short = need.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    short = short.select("source", "have", F.explode(F.expr("sequence(have, need - 1)")).alias("rank"))
    short = short.select((F.lit(slots) + (F.col("rank") - F.col("have")) * len(quotas) + F.col("source")).alias("slot"), "source", "rank")
    kept = rows.join(need, "source").where("rank < need").select("slot", "source", "rank")
    return kept.unionByName(short)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3, seed: int = 11) -> DataFrame:
    """Per document ``doc_id, size, source_size, target`` (its source's), ``taken, source, text_crc32, slots``.

    Sources in the order of their code points, null last, weigh ``weights``, repeating, and
    share ``share`` times all words. A source's documents, shuffled by a seeded hash, form a
    stream of words that starts over at its end and is cut into blocks of equal tokens; the
    schedule's slots of that source take its blocks in turn, up to its target. ``slots`` is a
    JSON array of {"slot", "at", "words"}: how many words of the document stand in the block of
    which slot, from which word of the block on, so that all rows sorted by slot and ``at`` are
    the mix in its order. ``taken`` is the sum of these words. The block grows with the input up to
    4,096 words, so there are about 2,000 slots a source at least.

    The driver sees one row per source, nothing per document. A null or empty text has size 0
    and takes nothing; null sources are one source; repeated rows and null ids are mixed each;
    an empty table gives no rows; reruns agree, whatever the partitions. Other columns are not
    read.
    """
    mix = scheduled(docs, weights, share, most, seed)
    listed = F.transform("slots", lambda x: F.struct(x["slot"].alias("slot"), x["at"].alias("at"), x["words"].alias("words")))
    return mix.withColumn("slots", F.to_json(listed))


def scheduled(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3, seed: int = 11) -> DataFrame:
    """``mix_sources`` with ``slots`` as an array of structs in order of the mix; ``first`` is true
    where the document begins."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", source_key().alias("_s"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialize(rows, "mix")
    found = {r._s: (r.words, r.n) for r in rows.groupBy("_s").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    names = sorted(x for x in found if x) + [x for x in found if not x]
    sizes = [found[x][0] for x in names]
    total, n = sum(sizes), sum(x[1] for x in found.values())
    target = target_words(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total, most)
    quotas = [min(round(t), int(most * s)) for t, s in zip(target, sizes, strict=True)]
    block = max(1, min(4096, total // (2000 * max(1, len(names)))))
    plan = spark.createDataFrame(list(zip(names, range(len(names)), sizes, target, quotas, strict=True)), "_s string, _i int, source_size long, target double, _quota long")

    cell, order = shuffle_order(seed, cells_for(n), "doc_id", "text_crc32")
    rows = rows.withColumns({"_cell": cell, "_h": order}).join(plan, "_s")
    stream = ranked(rows, ["_i"], "_cell", ["_h", "doc_id", "text_crc32", "size"], "size", "_at").select("doc_id", "source", "size", "text_crc32", "_i", "source_size", "target", "_quota", "_at")
    full = stream.where("size > 0")
    # A row for each time the stream is gone through, then one for each block that the document reaches into.
    turns = full.withColumn("_turn", F.explode_outer(F.expr("case when _quota > 0 then sequence(0L, (_quota - 1) div source_size) end")))
    turns = turns.withColumn("_from", F.col("_turn") * F.col("source_size") + F.col("_at"))
    turns = turns.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_quota")))
    pieces = turns.withColumn("rank", F.explode_outer(F.expr(f"case when _to > _from then sequence(_from div {block}, (_to - 1) div {block}) end")))
    begin = F.greatest(F.col("_from"), F.col("rank") * block)
    words = F.least(F.col("_to"), (F.col("rank") + 1) * block) - begin
    pieces = pieces.withColumns({"_words": words, "_in": begin - F.col("rank") * block, "_first": begin == F.col("_from")}).drop("_turn", "_from", "_to", "_quota")
    slots = schedule(spark, quotas, block).select(F.col("source").alias("_i"), "rank", "slot")
    keys = ["doc_id", "source", "size", "text_crc32", "_i", "source_size", "target", "_at"]
    piece = F.struct("slot", F.col("_in").alias("at"), F.col("_words").alias("words"), F.col("_first").alias("first"))
    taken = pieces.join(slots, ["_i", "rank"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), piece))).alias("slots"))
    taken = taken.withColumn("taken", F.aggregate("slots", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    out = ["doc_id", "size", "source_size", "target", "taken", "source", "text_crc32", "slots"]
    without = stream.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slots": F.array().cast(taken.schema["slots"].dataType)})
    return taken.select(*out).unionByName(without.select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in the order of its slots: each as often as its taken words
    hold it, to the nearest whole number, so some repeat and some go. A copy stands where the
    document begins in the mix; documents without words stay once, after all others. Rows that
    agree in id, source and text share what they take. All columns stay, whatever their names;
    nulls and empty tables are as in ``mix_sources``."""
    begins = F.transform(F.filter("slots", lambda x: x["first"]), lambda x: F.struct(x["slot"].alias("slot"), x["at"].alias("at")))
    mix = scheduled(docs, **options).withColumn("_begins", begins).groupBy("doc_id", "source", "text_crc32", "size")
    mix = mix.agg(F.sum("taken").alias("_taken"), F.count("*").alias("_rows"), F.array_sort(F.flatten(F.collect_list("_begins"))).alias("_begins"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("_taken") / (F.col("_rows") * F.col("size")) + 0.5)).cast("int")
    mix = mix.select(F.col("doc_id").alias("_d"), F.col("source").alias("_o"), F.col("text_crc32").alias("_c"), copies.alias("_copies"), "_begins").where("_copies > 0")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), crc.alias("crc"))
    same = F.col("id").eqNullSafe(F.col("_d")) & F.col("of").eqNullSafe(F.col("_o")) & (F.col("crc") == F.col("_c"))
    copied = mine.join(mix, same).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    place = F.get("_begins", F.col("copy"))
    copied = copied.select("row", place["slot"].alias("slot"), place["at"].alias("at"), "id", "crc")
    return copied.orderBy(F.asc_nulls_last("slot"), "at", "id", "crc").select("row.*")
