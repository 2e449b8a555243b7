import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import kneser_ney, quality_rules as q


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_base(which, request, labels):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality_rules(df, labels).collect())
    want = Counter()
    for r in df.collect():
        n, chars, symbols, dup, repeat = brute_counts(r.text)
        want[r.doc_id, n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n] += 1
    assert got == want


def test_binomial_bound():
    def cdf(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (10, 400, 1e-4), (7, 8, 0.05)):
        assert cdf(k, n, q.binomial_upper(k, n, delta)) == pytest.approx(delta, rel=1e-6)
        for p in (0.001, 0.04, 0.3, 0.9):
            assert q.binomial_below(k, n, p) == pytest.approx(cdf(k, n, p), rel=1e-9)
    assert q.binomial_below(39_000, 1_000_000, 0.04) == pytest.approx(1.6e-7, rel=0.1)
    assert q.binomial_upper(0, 0, 0.05) == 1 and q.binomial_upper(5, 5, 0.05) == 1


def brute_length(good, bad, limit, delta):
    best, n = (0.0, 0), sum(good)
    for k in range(1, len(good)):
        lost, caught = sum(good[:k]), sum(bad[:k])
        if q.binomial_upper(lost, n, delta) > limit:
            break
        best = max(best, (caught / max(1, sum(bad)) - lost / n, -k))
    return -best[1]


def test_lengths_of_paths():
    r = np.random.default_rng(0)
    some = 0
    for _ in range(300):
        n = int(r.integers(1, 3000))
        good = np.bincount(np.minimum(19, 19 - np.minimum(19, r.geometric(0.6, n // 10) - 1)), minlength=20)
        good[-1] += n - n // 10
        bad = r.integers(0, 20, 20).tolist()
        got = q.choose_length(good.tolist(), bad, 0.04, 0.01)
        assert got == brute_length(good.tolist(), bad, 0.04, 0.01)
        some += got > 0
    assert some > 100
    assert q.choose_length([0, 112], [9, 0], 0.04, 0.01) == 0  # too few to prove it
    assert q.choose_length([0, 113], [9, 0], 0.04, 0.01) == 1


def test_paths_take_the_best_step_first():
    # Rule 1 catches 5 bad at once; rule 0 catches 3 for 10 others, then 1 for 50.
    bad = [[0, 1, 0, 3], [0, 0, 0, 5], [0, 0, 0, 0]]
    others = [[100, 50, 0, 10], [160, 0, 0, 0], [160, 0, 0, 0]]
    assert q.rejection_path(bad, others) == [(1, 3), (0, 3), (0, 1)]
    assert q.rejection_path([[9, 0]], [[0, 0]]) == []


def test_lowest_of_a_step():
    for step in range(1, 50):
        low = q.lowest(step, 50)
        assert math.floor(low * 50) == step and math.floor(math.nextafter(low, 0) * 50) == step - 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_on_whole_tables(spark, sf):
    """Cutoffs and verdicts against brute force; on the larger table there are some."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    risk = q.Risk()
    rows = {r.doc_id: r for r in q.quality_rules(docs, labels).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    quality = {}
    for r in labels.collect():
        if r.quality is not None:
            quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    values = {i: [min(49, math.floor(r[x] * 50)) for x in q.RULES] for i, r in rows.items() if not r.base_failed}
    strata = {s: [i for i in values if lang[i] == s] for s in set(lang.values())}
    paths = {}
    for s, own in strata.items():
        bad, others = ([[sum(values[i][rule] == step for i in of) for step in range(50)] for rule in range(4)] for of in ([i for i in own if quality.get(i) == 0], [i for i in own if i not in quality]))
        if path := q.rejection_path(bad, others):
            paths[s] = path
    rejected = set()
    for s, path in paths.items():
        place = {i: next((k for k, (rule, step) in enumerate(path) if values[i][rule] >= step), len(path)) for i in strata[s]}
        good, bad = ([sum(place[i] == k for i in strata[s] if quality.get(i) == x) for k in range(len(path) + 1)] for x in (1, 0))
        taken = brute_length(good, bad, risk.false_rejection, 0.05 / len(paths)) if sum(good) else 0
        rejected |= {i for i in strata[s] if place[i] < taken}
    assert {i for i, r in rows.items() if r.kept} == set(values) - rejected
    if sf == "sf0.01":
        assert rejected and sum(quality.get(i) == 0 for i in rejected) > sum(quality.get(i) == 1 for i in rejected)


def test_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, f"{good} {i}", "en") for i in range(1500)] + [(2000 + i, f"{bad} {i}", "en") for i in range(50)] + [(5000, bad, "xx"), (5001, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)] + [(2000 + i, 0, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in q.quality_rules(df, labels).collect()}
    assert all(kept[i] for i in range(1500)) and not any(kept[2000 + i] for i in range(50)) and kept[5000] and kept[5001]
    assert {r.doc_id for r in q.kept_documents(df, labels).collect()} == {k for k, v in kept.items() if v}


def test_rules_without_labels(odd_docs, no_docs, labels, odd_labels):
    none = labels.limit(0)
    assert all(r.kept == (not r.base_failed) for r in q.quality_rules(odd_docs, none).collect())
    kept = Counter(r.doc_id for r in q.quality_rules(odd_docs, odd_labels).where("kept").collect())
    out = q.kept_documents(odd_docs, odd_labels)
    assert out.columns == odd_docs.columns and Counter(r.doc_id for r in out.collect()) == kept
    assert q.quality_rules(no_docs, none).count() == 0


def brute_model(texts):
    """Interpolated modified Kneser-Ney over code points from dictionaries."""
    edge = kneser_ney.EDGE
    three = Counter()
    for t in texts:
        s = [edge, edge, *map(ord, t or ""), edge]
        three.update(zip(s, s[1:], s[2:]))
    two = Counter(k[1:] for k in three)
    one = Counter(k[1:] for k in two)

    def level(counts):
        n = [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
        total, cut = Counter(), defaultdict(float)
        for k, v in counts.items():
            total[k[:-1]] += v
            cut[k[:-1]] += d[min(v, 3) - 1]
        return counts, d, total, cut

    levels = [level(one), level(two), level(three)]

    def p(history, w, order=3):
        if order == 0:
            return 1 / (edge + 1)
        counts, d, total, cut = levels[order - 1]
        h = history[len(history) - order + 1 :]
        below = p(history, w, order - 1)
        if not total[h]:
            return below
        c = counts[(*h, w)]
        return (c - d[min(c, 3) - 1] if c else 0) / total[h] + cut[h] / total[h] * below

    return p


def brute_perplexity(p, text):
    s = [kneser_ney.EDGE, kneser_ney.EDGE, *map(ord, text or ""), kneser_ney.EDGE]
    return len(s) - 2, sum(math.log10(p((a, b), c)) for a, b, c in zip(s, s[1:], s[2:]))


TRUSTED = ["the cat sat on the mat", "the dog", "a cat ate", "hello there, the end"] * 2 + ["zebra!"]


def test_kneser_ney(spark):
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in TRUSTED], "text string").repartition(3))
    p = brute_model(TRUSTED)
    for history in ((kneser_ney.EDGE,) * 2, (ord("t"), ord("h")), (ord("h"), ord("q")), (1, 2)):
        seen = {*map(ord, "".join(TRUSTED)), kneser_ney.EDGE}
        assert sum(p(history, w) for w in seen) + (kneser_ney.OUTCOMES - len(seen)) * p(history, 0x4E00) == pytest.approx(1)
    texts = ["the cat", "", None, "the cat", "a zoo", "漢字かな", "אבג", "漢漢漢漢", "the 漢"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_symbols, r.log10_prob) for r in kneser_ney.scored(df, ["doc_id"], model, chunk_bytes=20).collect()}
    for i, t in enumerate(texts):
        n, log = brute_perplexity(p, t)
        assert got[i][0] == n and got[i][1] == pytest.approx(log, rel=1e-9)
    assert got[5][1] < 4 * math.log10(1 / kneser_ney.OUTCOMES)  # no symbol stands for all unknown ones


def test_chunks_listed_in_parts(spark, docs, monkeypatch):
    model = kneser_ney.train(docs.limit(50))
    some = {r.row.doc_id: r.log10_prob for r in kneser_ney.scored(docs, ["doc_id"], model, chunk_bytes=20_000).collect()}
    monkeypatch.setattr(kneser_ney, "MOST_TASKS", 2)
    monkeypatch.setattr(kneser_ney, "HELD", 1)
    assert {r.row.doc_id: r.log10_prob for r in kneser_ney.scored(docs, ["doc_id"], model, chunk_bytes=20_000).collect()} == pytest.approx(some)


def test_texts_are_shuffled_once(spark, docs):
    model = kneser_ney.Model(spark.createDataFrame([], "kind int, code long, value double"), 1.0)
    out = kneser_ney.scored(docs, ["doc_id"], model)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_rows_with_texts_are_shuffled_with_one_copy(spark, docs):
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    model = kneser_ney.train(docs.limit(50))
    out = kneser_ney.scored(docs, docs.columns, model)
    dealt = [x.output() for x in nodes(out._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "RepartitionByExpression"]
    assert dealt and all({o.apply(i).name() for i in range(o.size())} == {"row", "chunk"} for o in dealt)
    got, texts = out.collect(), {r.doc_id: r.text for r in docs.collect()}
    narrow = {r.row.doc_id: (r.n_symbols, r.log10_prob) for r in kneser_ney.scored(docs, ["doc_id"], model).collect()}
    assert {r.row.doc_id: r.row.text for r in got} == texts
    assert all(narrow[r.row.doc_id] == (r.n_symbols, pytest.approx(r.log10_prob)) for r in got)


def test_memory_does_not_grow_with_a_batch():
    """Symbols of some 8 MB of texts are not spread out all at once: what a worker holds for it is bounded."""
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(97, 123, 2000))) for _ in range(4000)]
    rows = pa.array([{"doc_id": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([rows, pa.array(texts), pa.array(np.zeros(len(texts), np.int32))], ["row", "text", "chunk"])
    listed = [pa.Table.from_batches([b]) for b in kneser_ney._listed(iter([batch]))]
    entries = pa.concat_tables(listed).append_column("value", pa.array(np.full(sum(map(len, listed)), 0.5)))
    for work in (
        lambda: list(kneser_ney._count_trigrams(iter([batch]))),
        lambda: list(kneser_ney._listed(iter([batch]))),
        lambda: kneser_ney._scorer(1.0)(pa.Table.from_batches([batch]), entries),
    ):
        tracemalloc.start()
        out = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) and peak < 80e6


def test_verdicts_of_the_classifier(spark, docs, labels):
    """Thresholds and verdicts against brute force on a whole table."""
    options = {"quantile": 0.98, "most": 40, "fewest": 20, "alike": 15}
    got = {r.doc_id: r for r in kneser_ney.quality_classifier(docs, labels, **options).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    trusted = {r.doc_id for r in kneser_ney.trusted_ids(labels).collect()}
    chosen = [r.doc_id for r in kneser_ney.trusted_sample(labels, 40).collect()]
    assert len(chosen) == 40 and set(chosen) <= trusted == {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    p = brute_model([rows[i].text for i in chosen if i in rows])
    perplexity, band = {}, {}
    for i, r in rows.items():
        n, log = brute_perplexity(p, r.text)
        perplexity[i], band[i] = 10 ** (-log / n), min(n.bit_length(), kneser_ney.BANDS) - 1
        assert got[i].perplexity == pytest.approx(perplexity[i], rel=1e-6)
    lists = {lang: [i for i in trusted & set(rows) if lang in (None, rows[i].lang)] for lang in {r.lang for r in rows.values()} | {None}}
    for i, r in rows.items():
        own = lists[r.lang] if len(lists.get(r.lang, [])) >= 20 else lists[None]
        groups, held = [], []
        for b in range(kneser_ney.BANDS):
            held += [j for j in own if band[j] == b]
            if len(held) >= 15:
                groups.append((b, held))
                held = []
        groups[-1] = (kneser_ney.BANDS, groups[-1][1] + held)
        group = next(g for last, g in groups if band[i] <= last)
        bins = sorted(math.floor(math.log10(perplexity[j]) * 1000) for j in group)
        cut = 10 ** ((bins[math.ceil(0.98 * len(bins) - 1e-9) - 1] + 1) / 1000)
        assert got[i].threshold == pytest.approx(cut, rel=1e-9) and got[i].kept == (got[i].perplexity <= got[i].threshold)


def test_classifier(docs, labels, odd_docs, no_docs, odd_labels):
    got = kneser_ney.quality_classifier(docs, labels, fewest=5).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([r.kept for r in got if quality.get(r.doc_id) == x] for x in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5
    kept = kneser_ney.kept_documents(docs, labels, fewest=5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert kneser_ney.quality_classifier(odd_docs, odd_labels).count() == odd_docs.count()
    out = kneser_ney.kept_documents(odd_docs, odd_labels)
    assert out.columns == odd_docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kneser_ney.quality_classifier(odd_docs, odd_labels).where("kept").collect())
    assert all(r.kept for r in kneser_ney.quality_classifier(odd_docs, labels.limit(0)).collect())
    assert kneser_ney.quality_classifier(no_docs, labels).count() == 0 and kneser_ney.kept_documents(no_docs, labels).count() == 0


def test_short_texts_do_not_set_the_cutoff_of_long_ones(spark):
    r = np.random.default_rng(8)
    rows = [("de", int(n), float(p)) for n, p in zip(r.integers(200, 2000, 400), r.uniform(5, 10, 400), strict=True)]
    rows += [("de", 6, 25.0), ("de", 7, 20.0), ("fr", 6, 30.0)]
    by, pooled = kneser_ney.cutoffs(spark.createDataFrame(rows, "lang string, n_symbols long, perplexity double"), 0.999, 100, 100)
    assert set(by) == {"de"} and len(by["de"]) == len(pooled) == kneser_ney.BANDS
    assert by["de"][2] == pytest.approx(25, rel=3e-3) and pooled[2] == pytest.approx(30, rel=3e-3)
    assert by["de"][10] <= 10.03 and by["de"][31] <= 10.03 and pooled[10] <= 10.03


def test_kneser_ney_learns_from_all_trusted_documents(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang")
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 4 > 0 as int) as quality", "0 as toxic")
    seen, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda texts: seen.append(texts.count()) or train(texts))
    assert kneser_ney.quality_classifier(docs, labels).count() == 30_000
    assert seen == [22_500]


@pytest.mark.parametrize("most_bits", [6, 28])
def test_rows_of_ids_is_a_semi_join(spark, most_bits):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(500), 3, 7, None]], "doc_id int, text string")
    for chosen in ([], [3, 9, 499, 7000, 1 << 40], list(range(0, 500, 3))):
        ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
        got = kneser_ney.rows_of(docs, ids, most_bits=most_bits).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((i, f"t{i}") for i in [*range(500), 3, 7] if i in chosen)
