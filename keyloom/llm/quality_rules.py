"""Operator 8: quality rules with risk-controlled cutoffs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_by_bytes

#: The symbols that are counted, as fixed by the contract.
SYMBOLS = b"#*$%&|<>"
#: Rules; a document is the more suspect the higher the value.
RULES = ("symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    v = len(known)
    if v**3 < 1 << 62:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * v + ids[2:]
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[which] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``_COUNTS`` for one whole text; all zero for null."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # white space of bytes is exactly space and TAB to CR
    lines = [x for x in text.split("\n") if x.encode().split()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    white = int(counts[9:14].sum() + counts[32])
    symbols = int(sum(counts[c] for c in SYMBOLS))
    upper = sum(map(str.isupper, text)) if not raw.isascii() else int(counts[65:91].sum())
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeat_words(words), upper, len(lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in texts_by_bytes(batch, "text"):
            part = batch.slice(a, b - a)
            rows = [text_counts(t) for t in part.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *columns], ["doc_id", "stratum", *_COUNTS])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum``, the counts and the ratio of each rule, in one narrow stage."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS)
    df = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(_count, schema)

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return df.withColumns({"symbol_ratio": ratio("n_symbols", "word_chars"), "upper_ratio": ratio("n_upper", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words")})


def binomial_below(k: int, n: int, p: float) -> float:
    """The chance that of n events of chance ``p`` no more than k happen. Terms are added from the
    k-th down until they no longer count; below the mean they fall fast."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if p <= 0 or p >= 1:
        return 1.0 if p <= 0 else 0.0
    if k > n * p:  # the other tail is the short one
        return 1.0 - binomial_below(n - k - 1, n, 1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, odds = term, (1 - p) / p
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * odds
        total += term
        if term <= total * 1e-17:
            break
    return total


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound: the share p at which k or fewer of n have chance ``delta``."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_below(k, n, mid) > delta else (lo, mid)
    return hi


@dataclass(frozen=True)
class Risk:
    """false_rejection: bound on the share of good documents, among those that the base keeps, that
    each stratum may lose to all rules together. confidence: that all bounds hold at once. steps:
    cutoffs per rule."""

    false_rejection: float = 0.04
    confidence: float = 0.95
    steps: int = 50


def rejection_path(bad: list[list[int]], others: list[list[int]]) -> list[tuple[int, int]]:
    """(rule, step) by which cutoffs are tightened one after the other, from none on.

    bad, others: documents labelled bad, and documents without a label, per rule and step of its
    value. Each time the rule whose next step down to a bad document catches most bad ones for
    each other document moves; ties go to the first rule. Documents labelled good have no say,
    so that a test on them along the path is a test of hypotheses fixed beforehand.
    """
    at = [len(b) for b in bad]
    path = []
    while True:
        best = None
        for rule, counts in enumerate(bad):
            caught = lost = 0
            for step in range(at[rule] - 1, 0, -1):
                caught, lost = caught + counts[step], lost + others[rule][step]
                if caught and (best is None or caught * (best[1] + 1) > best[0] * (lost + 1)):
                    best = (caught, lost, rule, step)
        if best is None:
            return path
        at[best[2]] = best[3]
        path.append(best[2:])


def choose_length(good: list[int], bad: list[int], limit: float, delta: float) -> int:
    """How much of a path is taken. good, bad: labelled documents by the place on the path that
    rejects them first, those never rejected last.

    Places are tested from the loosest on, each against the whole ``limit``; the first that is not
    proven at level ``delta`` ends the sequence, so all before hold together. Of those the one
    wins that catches most bad documents for good ones lost, both as shares; ties go to the looser.
    """
    n, m, lost, caught, best = sum(good), sum(bad), 0, 0, (0.0, 0)
    for place in range(len(good) - 1):
        lost, caught = lost + good[place], caught + bad[place]
        if n == 0 or lost > limit * n or binomial_below(lost, n, limit) > delta:
            break
        best = max(best, (caught / max(1, m) - lost / n, -place - 1))
    return -best[1]


def choose_cutoffs(features: DataFrame, labels: DataFrame, risk: Risk) -> dict[tuple[str | None, str], float]:
    """Cutoffs by (stratum, rule) from all documents that the base keeps.

    Per stratum, one path of joint cutoffs over all rules is laid by the documents labelled bad and
    those without a label; then a fixed sequence of exact tests on those labelled good says how
    far to go. Bonferroni's correction divides the level by the number of strata, which is the
    number of sequences. What reaches the driver is a count for each stratum, rule, step and
    label, then one for each stratum, place and label: strata are languages, so a few thousand
    numbers at any size of the corpus.
    """
    seen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))
    steps = [F.least(F.floor(F.col(r) * risk.steps), F.lit(risk.steps - 1)).cast("int").alias(r) for r in RULES]
    binned = features.where(~base_failed()).select("doc_id", "stratum", *steps).join(seen, "doc_id", "left").select("stratum", "good", *RULES)
    # One row for each combination there is: at most some million, mostly a few hundred.
    binned = binned.groupBy("stratum", "good", *RULES).agg(F.count("*").alias("n"))
    rows = binned.select("stratum", "good", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("step")) for i, r in enumerate(RULES)])).alias("x"))
    counts: dict[str | None, tuple[list[list[int]], list[list[int]]]] = {}
    for r in rows.where("good is null or good <> 1").groupBy("stratum", "x.rule", "x.step", "good").agg(F.sum("n").alias("n")).collect():
        both = counts.setdefault(r.stratum, tuple([[0] * risk.steps for _ in RULES] for _ in range(2)))
        both[r.good is None][r.rule][r.step] += r.n
    paths = {stratum: path for stratum, (bad, others) in counts.items() if (path := rejection_path(bad, others))}
    if not paths:
        return {}
    place: Column = F.lit(None).cast("int")
    for stratum, path in paths.items():
        # The place that rejects each step of a rule first.
        firsts = [F.get(F.lit([next((i for i, (r, at) in enumerate(path) if r == rule and at <= step), len(path)) for step in range(risk.steps)]), F.col(name)) for rule, name in enumerate(RULES)]
        place = F.when(F.col("stratum").eqNullSafe(F.lit(stratum).cast("string")), F.least(*firsts)).otherwise(place)
    tested: dict[str | None, tuple[list[int], list[int]]] = {s: tuple([0] * (len(p) + 1) for _ in range(2)) for s, p in paths.items()}
    for r in binned.where("good is not null").withColumn("place", place).where("place is not null").groupBy("stratum", "place", "good").agg(F.sum("n").alias("n")).collect():
        tested[r.stratum][r.good != 1][r.place] += r.n
    out = {}
    for stratum, (good, bad) in tested.items():
        for rule, step in paths[stratum][: choose_length(good, bad, risk.false_rejection, (1 - risk.confidence) / len(paths))]:
            out[stratum, RULES[rule]] = lowest(step, risk.steps)  # a rule's steps go down along the path
    return out


def lowest(step: int, steps: int) -> float:
    """The lowest value of a step: the smallest number that ``floor(number * steps)`` takes there."""
    value = step / steps
    while math.floor(value * steps) < step:
        value = math.nextafter(value, math.inf)
    while math.floor((below := math.nextafter(value, -math.inf)) * steps) >= step:
        value = below
    return value


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_quality_rules(features: DataFrame, cutoffs: dict[tuple[str | None, str], float]) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    rejected: Column = F.lit(False)
    for (stratum, rule), cutoff in sorted(cutoffs.items(), key=lambda x: (x[0][0] or "", x[0][0] is None, x[0][1])):
        rejected = rejected | (F.col("stratum").eqNullSafe(F.lit(stratum).cast("string")) & (F.col(rule) >= cutoff))
    return features.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Per document ``doc_id``, the counts, ratios, ``base_failed`` and ``kept``.

    Null text: no words, so base_failed. Null lang: a stratum of its own. Null labels are not
    used; a document labelled twice is good only if every label says so. A stratum with too
    few good labelled documents to prove a cutoff (some 110) has none, and its rules reject
    nothing. No labels or an empty table: only the base decides. Repeated rows give repeated
    results. Other columns are not read, whatever their names.
    """
    from .common import materialize

    features = materialize(measured(docs), "rules")
    return apply_quality_rules(features, choose_cutoffs(features, labels, risk))


def _filter(cutoffs: dict[tuple[str | None, str], float], text: str, stratum: str):
    parts = {"symbol_ratio": (2, 1), "upper_ratio": (5, 1), "dup_line_ratio": (3, 6), "repeat_ratio": (4, 0)}

    def good(counts: tuple[int, ...], of: str | None) -> bool:
        if counts[0] < 50 or 100 * counts[4] > 50 * counts[0]:
            return False
        return not any(counts[b] and counts[a] / counts[b] >= cutoffs.get((of, rule), math.inf) for rule, (a, b) in parts.items())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in texts_by_bytes(batch, text):
                part = batch.slice(a, b - a)
                strata = part.column(stratum).to_pylist()
                yield part.filter(pa.array([good(text_counts(t), s if s is None else str(s)) for t, s in zip(part.column(text).to_pylist(), strata, strict=True)], pa.bool_()))

    return keep


def kept_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns, whatever their names. The verdict is
    a function of the row and the cutoffs, so texts are counted again rather than shuffled.
    Nulls, repeated rows and empty tables are as in ``quality_rules``."""
    from .common import materialize

    features = materialize(measured(docs, stratum), "rules")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any letters are out of the way
    text, of = (f"c{docs.columns.index(c)}" for c in ("text", stratum))
    return plain.mapInArrow(_filter(choose_cutoffs(features, labels, risk), text, of), plain.schema).toDF(*docs.columns)
