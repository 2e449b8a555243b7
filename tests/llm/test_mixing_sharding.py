import json
import re
import zlib
from collections import Counter, defaultdict

import pytest

from keyloom.llm import mixing, sharding


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    size = defaultdict(int)
    for r in rows:
        size[r.source] += words(r.text)
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(size.values()), {s for s in names if not size[s]}
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * size[s] + 1e-9}
        if not over:
            return size, {s: share.get(s, 3.0 * size[s]) for s in names}
        capped |= over


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = mixing.mix_sources(df).collect()
    size, target = brute_targets(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_nothing(no_docs, spark):
    assert mixing.mix_sources(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sources(empty).collect()] == [(0, 0, 0.0)] * 2


def test_one_huge_source(spark):
    rows = [(i, "w " * 50, "big") for i in range(500)] + [(1000, "w " * 3, "tiny"), (1001, "w " * 400, "mid")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert by["tiny"] == 9 and by["mid"] == 1200 and by["big"] == 25403 - 1209


def test_schedule_is_even(spark):
    slots = mixing.schedule(spark, [1000, 2000, 5000], 1).where("slot < 800").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in slots} == {0: pytest.approx(100, abs=4), 1: pytest.approx(200, abs=4), 2: pytest.approx(500, abs=4)}
    ranks = mixing.schedule(spark, [1000, 2000, 5000], 7).groupBy("source", "rank").count().collect()
    assert Counter(r.source for r in ranks) == {0: 143, 1: 286, 2: 715} and all(r["count"] == 1 for r in ranks)


def begins(rows):
    """(slot, at) of each piece by document, in order of the mix."""
    return {r.doc_id: sorted((x["slot"], x["at"]) for x in json.loads(r.slots)) for r in rows}


def test_slots_hold_the_mix_in_order(spark):
    rows = [(i, "w " * (1 + i % 37), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r.size for r in got)
    block = max(1, min(4096, total // 6000))
    slots, filled = defaultdict(set), defaultdict(list)
    for r in got:
        pieces = json.loads(r.slots)
        assert sum(x["words"] for x in pieces) == r.taken
        for x in pieces:
            slots[x["slot"]].add(r.source)
            filled[x["slot"]].append((x["at"], x["words"]))
    # One source a slot, filled without gaps; every stretch of the mix has its sources by their shares.
    assert all(len(s) == 1 for s in slots.values())
    for parts in filled.values():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at <= block
    order, share = [next(iter(slots[s])) for s in sorted(slots)], defaultdict(int)
    for r in got:
        share[r.source] += r.taken / total
    for a in range(0, len(order) - 500, 500):
        for source, x in share.items():
            assert abs(order[a : a + 500].count(source) / 500 - x) < 0.03


def test_mixed_documents_follow_the_slots(spark):
    rows = [(i, f"{i} " + "w " * (i % 37), "abc"[i % 3]) for i in range(900)] + [(1000, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, by = [r.doc_id for r in mixing.mixed_documents(df).collect()], begins(mixing.mix_sources(df).collect())
    assert out.pop() == 1000 and 1000 not in out
    seen, last = Counter(), (-1, -1)
    for x in out:
        place = next(p for p in by[x] if p > last or p == last)
        last, seen[x] = place, seen[x] + 1
    thirds = [Counter("abc"[x % 3] for x in out[k : k + len(out) // 3]) for k in (0, len(out) // 3, 2 * (len(out) // 3))]
    for s in "abc":
        assert max(t[s] for t in thirds) - min(t[s] for t in thirds) < 0.1 * len(out)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    mix = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: int(r.taken / r.size + 0.5) if r.size else 1 for k, r in mix.items() if not r.size or int(r.taken / r.size + 0.5)})


def test_mixed_odd_documents(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert {r.text for r in out.collect()} <= {r.text for r in odd_docs.collect()}
    assert mixing.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = sharding.interleaved_shards(df, 7).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), r.source) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == want
    slots, mixture, total = defaultdict(list), defaultdict(Counter), Counter(r.source for r in rows)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        mixture[r.shard][r.source] += 1
    sizes = [len(x) for x in slots.values()]
    assert set(slots) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for shard, by in mixture.items():
        for source, n in total.items():
            assert abs(by[source] - n * len(slots[shard]) / len(rows)) <= 2
    again = sharding.interleaved_shards(df.repartition(5), 7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shards_of_few_or_no_rows(spark, no_docs):
    few = spark.createDataFrame([(1, "a", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.shard, r.slot) for r in sharding.interleaved_shards(few).collect()) == [(0, 0), (1, 0)]
    assert sharding.interleaved_shards(no_docs).count() == 0


def test_sharding_is_native(docs):
    plan = sharding.interleaved_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
