"""Operator 7: an interpolated modified Kneser-Ney character n-gram model of trusted text.

Symbols are code points, whatever the script; n-grams of up to three stand in one integer.
Counts are tables keyed by n-gram; context totals, continuation counts and lower orders are
joined to them by context, so the model is a table of any size. Documents are dealt to chunks
by a hash; a chunk lists its different n-grams once, their shares are joined to the list by
n-gram, and all texts of the chunk are scored from that.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import MOST_TASKS, chunk_parts, joined_by_key, materialize, release_memory, small_batches, texts_by_bytes

#: The edge of a text, one above all code points; bits of a symbol.
EDGE, BITS = 0x110000, 21
#: What can come next: every code point, or the end.
OUTCOMES = EDGE + 1
#: Chunks whose lists a task holds at once.
HELD = 64
#: Bytes of text whose symbols are spread out at once, some 50 times as many bytes.
BLOCK = 1 << 20
#: Lengths are compared by the power of two below them.
BANDS = 32
#: Kinds of entries of a model: discounted shares of n-grams, and what contexts leave to lower orders.
SHARES, LEFT = {3: 3, 2: 2, 1: 1}, {3: 5, 2: 4}


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each symbol of each text, its end included, with two edges before a
    text; and how many each text has."""
    edge, parts, sizes = np.full(2, EDGE, "<u4"), [], []
    for t in texts:
        points = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
        parts += [edge, points, edge[:1]]
        sizes.append(len(points) + 1)
    s, n = np.concatenate(parts).astype(np.int64) if parts else np.zeros(2, np.int64), np.array(sizes, np.int64)
    codes = s[:-2] << 2 * BITS
    codes |= s[1:-1] << BITS
    codes |= s[2:]
    inside = np.ones(len(codes), bool)
    for over in (1, 2):  # trigrams that reach over into the edges of the next text
        at = np.cumsum(n + 2)[:-1] - over
        inside[at] = False
    return codes[inside], n


def lower(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The last symbols of n-grams."""
    return codes & ((1 << symbols * BITS) - 1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of some ``BLOCK`` bytes, with their texts: a column, or a field of the rows."""
    texts = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
    for a, b in texts_by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), "text", BLOCK):
        yield a, b, texts.slice(a, b - a).to_pylist()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in _blocks(batch):
            codes, n = np.unique(trigrams(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])
    release_memory()


def _smoothed(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame | float]:
    """Modified Kneser-Ney of one order: (code, value) discounted shares by n-gram, and (code, value)
    the mass left to the lower order by context, a number for single symbols. Discounts for
    counts of 1, 2, 3 and more come from the counts of counts."""
    r = counts.agg(F.count("*").alias("size"), *[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    size, n = r.size, [r[f"n{i}"] or 0 for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    discounts = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
    cut = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
    if order == 1:
        whole = counts.agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")).first()
        total = F.lit(whole.total or 1)
        return counts.select("code", ((F.col("n") - cut) / total).alias("value")), 1.0 if whole.cut is None else whole.cut / whole.total
    counts = counts.withColumn("h", F.shiftright("code", BITS))
    contexts = materialize(counts.groupBy("h").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"), F.count("*").alias("kinds")), "contexts")
    shares = joined_by_key(counts, contexts, "h", "kinds", size).select("code", ((F.col("n") - cut) / F.col("total")).alias("value"))
    return shares, contexts.select(F.col("h").alias("code"), (F.col("cut") / F.col("total")).alias("value"))


@dataclass(frozen=True)
class Model:
    """entries: (kind, code, value) by ``SHARES`` and ``LEFT``, a stored table. left: the mass that
    single symbols leave to all outcomes alike."""

    entries: DataFrame
    left: float


def train(texts: DataFrame) -> Model:
    """A model of the column ``text``. Without any text all outcomes are equally likely."""
    with small_batches(texts.sparkSession):
        three = materialize(texts.select("text").mapInArrow(_count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "trigrams")
    # Continuation counts: of how many different symbols an n-gram comes after.
    two = materialize(three.groupBy(F.col("code").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("code")).agg(F.count("*").alias("n")), "bigrams")
    one = two.groupBy(F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)).alias("code")).agg(F.count("*").alias("n"))
    parts, left = [], 1.0
    for order, counts in ((3, three), (2, two), (1, one)):
        shares, contexts = _smoothed(counts, order)
        parts.append(shares.withColumn("kind", F.lit(SHARES[order])))
        if order > 1:
            parts.append(contexts.withColumn("kind", F.lit(LEFT[order])))
        else:
            left = contexts
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return Model(materialize(entries.select("kind", "code", "value"), "model"), left)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, code): all that the scores of a chunk's texts need. A chunk whose rows come far
    apart is listed in parts, which may repeat each other."""
    held: dict[int, list[np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for chunk, own in held.items():
            three = np.unique(np.concatenate(own))
            wanted = {SHARES[3]: three, LEFT[3]: three >> BITS, SHARES[2]: lower(three, 2), LEFT[2]: lower(three, 2) >> BITS, SHARES[1]: lower(three, 1)}
            for kind, codes in wanted.items():
                codes = np.unique(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), chunk, np.int32)), pa.array(np.full(len(codes), kind, np.int32)), pa.array(codes)], ["chunk", "kind", "code"])
        held.clear()

    for number, batch in chunk_parts(batches):
        if number not in held and len(held) >= HELD:
            yield from out()
        own = held.setdefault(number, [])
        for _, _, texts in _blocks(batch):
            own.append(np.unique(trigrams(texts)[0]))
            if len(own) > 8:
                own[:] = [np.unique(np.concatenate(own))]
    yield from out()
    release_memory()


def trigram_logs(entries: pa.Table, left: float) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a list, ascending, and the log10 probability of the last symbol of each after
    the two before. Entries without a value are not in the model."""
    kinds, codes = entries.column("kind").to_numpy(), entries.column("code").to_numpy()
    values = entries.column("value").to_numpy()
    by = {}
    for kind in (*SHARES.values(), *LEFT.values()):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(codes[own])]
        missing = 1.0 if kind in LEFT.values() else 0.0
        by[kind] = codes[own], np.where(np.isnan(values[own]), missing, values[own])

    def value(kind: int, of: np.ndarray) -> np.ndarray:
        return by[kind][1][np.searchsorted(by[kind][0], of)]

    three = by[SHARES[3]][0]
    two, one = lower(three, 2), lower(three, 1)
    p = value(SHARES[1], one) + left / OUTCOMES
    p = value(SHARES[2], two) + value(LEFT[2], two >> BITS) * p
    p = value(SHARES[3], three) + value(LEFT[3], three >> BITS) * p
    return three, np.log10(p)


def _scorer(left: float) -> Callable:
    def totals(texts: list[str | None], known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, n = trigrams(texts)
        return n, np.add.reduceat(logs.take(np.searchsorted(known, codes)), np.cumsum(n) - n)

    def score(texts: pa.Table, entries: pa.Table) -> pa.Table:
        known, logs = trigram_logs(entries, left)
        out = []
        for batch in texts.to_batches():
            for a, b, own in _blocks(batch):
                n, total = totals(own, known, logs)
                out.append(pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(n), pa.array(total)], ["row", "n_symbols", "log10_prob"]))
        release_memory()
        return pa.Table.from_batches(out, pa.schema([("row", texts.schema.field("row").type), ("n_symbols", pa.int64()), ("log10_prob", pa.float64())]))

    return score


def scored(docs: DataFrame, columns: list[str], model: Model, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``row`` (a struct of ``columns``), ``n_symbols`` (characters and the end) and ``log10_prob`` of
    each document of ``docs``.

    Texts are shuffled once, by chunk, and read twice from there: to list the chunk's n-grams and
    to score. Where ``columns`` has the text, it travels in the row alone. A chunk's list is joined
    to the model by n-gram: an n-gram has one row a chunk, however often it occurs.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    tasks = min(chunks, MOST_TASKS)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    beside = [] if "text" in columns else [F.col("text").alias("text")]
    keyed = docs.select(row.alias("row"), *beside, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")).repartition(tasks, "chunk")
    listed = keyed.mapInArrow(_listed, "chunk int, kind int, code long")
    entries = listed.join(model.entries, ["kind", "code"], "left").select("chunk", "kind", "code", "value")
    pairs = keyed.groupBy("chunk").cogroup(entries.groupBy("chunk"))
    schema = keyed.select("row").schema.add("n_symbols", "long").add("log10_prob", "double")
    return pairs.applyInArrow(_scorer(model.left), schema)


def rows_of(docs: DataFrame, ids: DataFrame, per_id: int = 16, most_bits: int = 28) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in the stored, distinct ``ids``: a semi-join that moves no
    texts, whatever the number of ids.

    A Bloom filter of some ``per_id`` bits an id, 2 ** ``most_bits`` in all at most, goes to all tasks. The
    ids it lets through by mistake are found from the id columns alone, and their rows taken out.
    """
    spark = docs.sparkSession
    ids = ids.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id is not null")
    bits = min(most_bits, max(6, (per_id * ids.count()).bit_length()))

    def places(key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(1 << bits)) for i in range(3)]

    words = ids.select(F.explode(F.array(*places(F.col("doc_id")))).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[found.column("word").to_numpy()] = found.column("set").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @arrow_udf("boolean")
    def maybe(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        held = np.ones(len(a), bool)
        for at in (x.to_numpy(zero_copy_only=False) for x in (a, b, c)):
            held &= shared.value[at >> 6] >> (at & 63) & 1 == 1
        return pa.array(held)

    let = docs.where("doc_id is not null").where(maybe(*places(F.col("doc_id"))))
    wrong = materialize(let.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "untrusted")
    return let.join(wrong, "doc_id", "left_anti")


def trusted_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` doc_ids that are labelled good and not toxic, by a seeded hash."""
    return trusted_ids(labels).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most)


def cutoffs(found: DataFrame, q: float, fewest: int, alike: int, bins: int = 1000) -> tuple[dict[str | None, list[float]], list[float]]:
    """The ``q`` quantile of perplexity among documents of comparable length, for each of the
    ``BANDS``: by language, and over all languages (infinite without rows).

    From the shortest on, bands are taken together until they hold ``alike`` rows; what is left at
    the end joins the last group. Languages of under ``fewest`` rows have none. Exact but for
    rounding up to 1 / ``bins`` of a decade: the driver sees a histogram, whose size depends on
    languages and bins only.
    """
    rows = found.groupBy("lang", _band().alias("band"), F.floor(F.log10("perplexity") * bins).alias("bin")).count().collect()

    def cut(of: Counter) -> float:
        total, seen = sum(of.values()), 0
        for bin_ in sorted(of):
            seen += of[bin_]
            if seen >= q * total:
                return 10 ** ((bin_ + 1) / bins)
        return float("inf")

    def by_band(of: list) -> list[float]:
        groups, start, held = [], 0, Counter()
        for i in range(BANDS):
            for r in of:
                if r.band == i:
                    held[r.bin] += r["count"]
            if held.total() >= alike:
                groups.append((start, held))
                start, held = i + 1, Counter()
        if groups:
            groups[-1][1].update(held)
        else:
            groups = [(0, held)]
        out = [0.0] * BANDS
        for start, held in groups:
            out[start:] = [cut(held)] * (BANDS - start)
        return out

    by = {lang: [r for r in rows if r.lang == lang] for lang in {r.lang for r in rows}}
    return {lang: by_band(of) for lang, of in by.items() if sum(r["count"] for r in of) >= fewest}, by_band(rows)


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, most: int | None = None, fewest: int = 100, alike: int = 100) -> DataFrame:
    """Per document ``doc_id, lang, n_symbols, log10_prob, perplexity, threshold, kept``.

    The model is trained on all whole trusted texts (labelled quality 1 and not toxic), or on
    ``most`` of them, picked by a hash of the id. A document is kept if its perplexity per symbol is at
    most its threshold: the ``quantile`` of all trusted documents of its language and of
    comparable length, at least ``alike`` of them if there are so many, in the whole table. A language with under
    ``fewest`` trusted documents, and a null language, take the quantiles of all; without trusted
    documents everything is kept.
    A null or empty text is scored for its end alone. Null ids are scored but never trusted;
    repeated rows give repeated results; an empty table none; other columns are not read.
    """
    found, by, pooled = _measured(docs, ["doc_id", "lang"], labels, quantile, most, fewest, alike)
    found = found.select("row.doc_id", F.col("row.lang").cast("string").alias("lang"), "n_symbols", "log10_prob", "perplexity")
    found = found.withColumn("threshold", _threshold(F.col("lang"), by, pooled))
    return found.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def kept_documents(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, most: int | None = None, fewest: int = 100, alike: int = 100) -> DataFrame:
    """The rows of ``docs`` that ``quality_classifier`` keeps, with all columns, whatever their names.
    Nulls, repeated rows and empty tables are as there: a repeated row stays or goes with all its
    repetitions."""
    found, by, pooled = _measured(docs, docs.columns, labels, quantile, most, fewest, alike)
    stay = found.where(F.col("perplexity") <= _threshold(F.col("row.lang").cast("string"), by, pooled))
    return stay.select("row.*")


def _measured(docs: DataFrame, columns: list[str], labels: DataFrame, quantile: float, most: int | None, fewest: int, alike: int) -> tuple[DataFrame, dict[str | None, list[float]], list[float]]:
    """Stored scores of all documents, and cutoffs by language and over all."""
    ids = materialize(trusted_ids(labels) if most is None else trusted_sample(labels, most), "trusted")
    model = train(rows_of(docs.select("doc_id", "text"), ids))
    found = scored(docs, columns, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_symbols")))
    with small_batches(docs.sparkSession):
        found = materialize(found, "perplexity")
    known = found.select("row.doc_id", F.col("row.lang").cast("string").alias("lang"), "n_symbols", "perplexity")
    return found, *cutoffs(known.join(trusted_ids(labels), "doc_id", "left_semi"), quantile, fewest, alike)


def _band() -> Column:
    return F.least(F.length(F.bin("n_symbols")), F.lit(BANDS)) - 1


def _threshold(lang: Column, by: dict[str | None, list[float]], pooled: list[float]) -> Column:
    cut = F.get(F.lit(pooled), _band())
    for name, values in sorted((k, v) for k, v in by.items() if k is not None):
        cut = F.when(lang == name, F.get(F.lit(values), _band())).otherwise(cut)
    return cut


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id")
