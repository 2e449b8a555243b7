import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import attention_lm as lm
from keyloom.llm import simhash
from keyloom.llm.common import joined_by_key, small_batches
from keyloom.llm.components import connected_components

WORD = str(P.path("word_bpe_49k.json"))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold=4):
    """The component of each distinct value."""
    values, root = sorted(set(fps)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    a = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= threshold):
            x, y = find(v), find(values[i + 1 + j])
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def check(df):
    rows = df.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    component, least = brute_components(fps), {}
    for r, f in zip(rows, fps, strict=True):
        if r.doc_id is not None:
            c = component[f]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least.get(component[f])) for r, f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    return want


def test_near_duplicates(spark, docs, odd_docs, no_docs):
    check(docs)
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies(spark):
    r = np.random.default_rng(1)
    base = [f"w{r.integers(400)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + ["new"] * (i % 3) + base[k:])) for i, k in enumerate(r.integers(0, 400, 120).tolist())]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(Counter(k[2] for k in want).values()) > 20
    stay = simhash.one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in stay.collect()} == {k[2] for k in want}


@pytest.mark.parametrize("hot, layout", [(20_000, simhash.THREE), (30, simhash.THREE), (20_000, simhash.TWO), (3, simhash.TWO)])
def test_links_against_all_pairs(spark, hot, layout, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = np.random.default_rng(2)
    fps = set(r.integers(0, 1 << 63, 300).tolist()) | {0, (1 << 64) - 1, 1, 7, 31}
    for b in list(fps)[:100]:
        for _ in range(3):
            y = b
            for bit in r.choice(64, int(r.integers(1, 7)), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.near_links(df, layout=layout)
    for a, b in links.collect():
        assert a != b
    got = {x.node & (2**64 - 1): x.root for x in connected_components(links).collect()}
    want = brute_components(fps)
    groups = {}
    for v, root in want.items():
        groups.setdefault(root, set()).add(v)
    linked = {v for g in groups.values() if len(g) > 1 for v in g}
    assert set(got) == linked
    assert all(len({got[v] for v in g}) == 1 for g in groups.values() if len(g) > 1)
    assert len(set(got.values())) == sum(len(g) > 1 for g in groups.values())


def test_home_anchors_and_copies():
    fp = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 500)
    for layout, copies in ((simhash.THREE, 42), (simhash.TWO, 344)):
        index, place = simhash.anchors(fp, 4, layout)
        assert np.bincount(index[place & 1 == 1], minlength=500).tolist() == [len(layout.blocks)] * 500
        assert np.bincount(index).mean() == pytest.approx(copies, rel=0.05)
        assert len(set(zip(index.tolist(), (place >> 1).tolist()))) == len(place)


def test_hot_keys_are_joined_where_they_are(spark):
    rows = spark.range(5000).selectExpr("if(id < 4000, 7, id) as k", "id as v")
    of = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", F.col("k") + 1)
    out = joined_by_key(rows, of, "k", "n", 5000)
    assert sorted((r.k, r.v, r.n, r.w) for r in out.collect()) == sorted((k, v, 4000 if k == 7 else 1, k + 1) for v in range(5000) for k in [7 if v < 4000 else v])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (300, 200), (300, 250)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language model ------------------------------------------------------------------------


def toy():
    r = np.random.default_rng(0)
    pairs = r.integers(0, 4, (lm.SYMBOLS + 1, lm.SYMBOLS)).astype(float)
    flat = lm.first_params() + r.normal(0, 0.1, lm.first_params().shape).astype(np.float32)
    return lm.Prior(pairs), flat


def test_gradient():
    prior, flat = toy()
    r = np.random.default_rng(1)
    given = r.integers(0, lm.SYMBOLS + 1, (3, lm.WINDOW))
    wanted = r.integers(-1, lm.SYMBOLS, (3, lm.WINDOW))
    _, g = lm.loss_and_gradient(flat.astype(np.float64), prior, given, given, wanted)
    for at in [*r.integers(0, len(flat), 20).tolist(), *np.argsort(-abs(g))[:20].tolist()]:
        step = np.zeros(len(flat))
        step[at] = 1e-4
        up, down = (lm.loss_and_gradient(flat + s * step, prior, given, given, wanted)[0] for s in (1, -1))
        assert (up - down) / 2e-4 == pytest.approx(float(g[at]), abs=2e-3)


def test_scores_are_probabilities_and_each_id_counts_once():
    prior, flat = toy()
    counts = np.zeros(3000)
    counts[:2000] = np.arange(2000, 0, -1)
    symbols = lm.Symbols(counts, np.arange(3000) % 3 == 0)
    scorer = lm.Scorer(flat, prior, symbols)
    # After any two ids, the next id's probabilities sum to 1.
    alone = scorer.score([np.array([5, 1500])])[0]
    total = (10.0 ** (scorer.score([np.array([5, 1500, i]) for i in range(3000)]) - alone)).sum()
    assert total == pytest.approx(1, abs=1e-3)
    # A long sequence against windows taken one by one.
    ids = np.random.default_rng(3).integers(0, 3000, 101)
    given = np.r_[lm.START, symbols.symbol[ids][:-1]]
    want, done = symbols.rare[ids].sum(), 0
    for start in range(0, 101, lm.STRIDE):
        part, aim = given[start : start + lm.WINDOW], symbols.symbol[ids][start : start + lm.WINDOW]
        pad = lm.WINDOW - len(part)
        pick = np.zeros((1, lm.WINDOW), bool)
        pick[0, (done - start) : len(part)] = True
        logs = scorer.symbol_logs(np.pad(part, (0, pad))[None], np.pad(aim, (0, pad))[None], pick)
        want += logs.sum() / math.log(10)
        done += len(logs)
        if done == 101:
            break
    assert done == 101 and scorer.score([ids])[0] == pytest.approx(want, rel=1e-4)


def test_ids_past_the_first_window_have_half_a_window_before_them(monkeypatch):
    prior, flat = toy()
    scorer, picks = lm.Scorer(flat, prior, lm.Symbols(np.arange(3000, 0, -1.0), np.zeros(3000, bool))), []
    logs = scorer.symbol_logs
    monkeypatch.setattr(scorer, "symbol_logs", lambda given, wanted, pick, skip: picks.append((skip, given, pick)) or logs(given, wanted, pick, skip))
    scorer.score([np.arange(101)])
    (first, _, all_), (rest, given, pick) = picks
    assert (first, rest) == (0, lm.WINDOW - lm.STRIDE) and all_.all() and given.shape[1] - pick.shape[1] == lm.WINDOW // 2
    assert all_.sum() + pick.sum() == 101


def trained_on(texts):
    """(symbols, the wanted symbols of each step of a trainer over ``texts``)."""
    enc = lm.encoder(WORD, False)
    size = enc.tokenizer.get_vocab_size() + 2
    counts = np.arange(size, 0, -1.0)
    shared = type("Shared", (), {"value": (toy()[0], lm.Symbols(counts, np.zeros(size, bool)))})
    seen = []

    def fit(flat, prior, batches, rate):
        seen.extend(w for _, _, w in batches)
        return flat, sum(map(len, seen)), sum(int((w >= 0).sum()) for w in seen)

    ids = [lm.text_ids(enc, pa.array([t], pa.binary()))[0].astype(lm.id_type(enc)).tobytes() for t in texts]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "fit", fit)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(ids, pa.binary())], ["shard", "ids"])
        (out,) = lm._trainer(lm.id_type(enc), lm.first_params(), shared, 0.01, 0)(iter([batch]))
    assert out.column("ids")[0].as_py() == sum(len(x) for x in ids) // lm.id_type(enc).itemsize
    return shared.value[1], seen


def wanted_once(texts):
    symbols, seen = trained_on([t.encode() for t in texts])
    enc, want = lm.encoder(WORD, False), Counter()
    for t in texts:
        ids = [*np.frombuffer(enc.encode(t), enc.dtype).tolist(), enc.tokenizer.get_vocab_size()]
        want.update(symbols.symbol[ids].tolist())
    got = Counter(np.concatenate([w.ravel() for w in seen]).tolist())
    got.pop(-1, None)
    assert got == want


def test_every_training_id_is_a_target_once():
    r = np.random.default_rng(6)
    wanted_once([" ".join(f"word{x}" for x in r.integers(0, 300, n)) for n in (0, 1, 15, 16, 17, 4000)])


@pytest.mark.parametrize("space", ["\n", "\t", "\r\n"])
def test_training_texts_without_blanks_between_words(space):
    wanted_once([space.join(f"word{i % 997}" for i in range(5000))])


@pytest.mark.parametrize("run", ["a1b2-", "漢字かな"])
def test_long_training_texts_without_white_space(run):
    text = (run * (3_000_000 // len(run.encode()))).encode()
    tracemalloc.start()
    _, seen = trained_on([text, b"x"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = sum(int((w >= 0).sum()) for w in seen)
    enc = lm.encoder(WORD, False)
    assert ids == len(enc.encode(text.decode())) // enc.dtype.itemsize + 3  # x and two ends
    assert peak < 600 << 20  # not a slice of the text for each window


def test_training_windows_of_texts():
    ids, sizes = np.arange(45), np.array([1, 16, 28])
    given, wanted = lm.training_windows(ids, sizes, lm.Symbols(np.arange(2000, 0, -1.0), np.zeros(2000, bool)))
    assert wanted[wanted >= 0].tolist() == ids.tolist() and [(w >= 0).sum() for w in wanted] == [1, 16, 16, 12]
    assert given[:, 0].tolist() == [lm.START, lm.START, lm.START, 32]
    assert (given[:, 1:] == wanted[:, :-1])[wanted[:, 1:] >= 0].all()


def brute_base(rows):
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]

    held = {r: zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 1 for r in rows}
    c = Counter(w for r in rows if not held[r] for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        w = tokens(r.text)
        out.append((r.doc_id, held[r], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_language_model(which, request):
    df = request.getfixturevalue(which)
    key = lambda x: repr(x[:5])
    got = sorted((tuple(r) for r in lm.score_documents(df.repartition(3), WORD, chunk_bytes=60_000).collect()), key=lambda x: (key(x), x[5]))
    want = sorted(brute_base([r for r in df.collect()]), key=lambda x: (key(x), x[5]))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0 and math.isfinite(g[6])
    if which == "docs":
        again = lm.score_documents(df, WORD, chunk_bytes=60_000).collect()
        assert {r.doc_id: r.score for r in again} == pytest.approx({x[0]: x[6] for x in got}, rel=1e-3)


def held_out_words(df, **options):
    """log10 a held-out word by the model and by the base."""
    rows = [r for r in lm.score_documents(df, WORD, **options).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    return sum(r.score for r in rows) / n, sum(r.base_score for r in rows) / n


def test_the_model_learns_and_trains_on_every_id(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done, train = [], lm.train

    def counted(texts, dtype, *args, **options):
        flat, n = train(texts, dtype, *args, fewest=0, **options)
        done.append((n, texts.selectExpr(f"sum(octet_length(ids)) div {dtype.itemsize} as n").first().n))
        return flat, n

    with monkeypatch.context() as m:
        m.setattr(lm, "train", counted)
        held_out_words(df)
    assert done[0][0] == done[0][1] > 500_000  # each id of all training texts once
    model, base = held_out_words(df)
    with monkeypatch.context() as m:  # no attention: the parameters stay zero
        m.setattr(lm, "train", lambda *a, **k: (np.zeros_like(lm.first_params()), 0))
        without, _ = held_out_words(df)
    assert model > base + 0.02 and model > without + 0.3


def test_words_without_ids_cost(spark):
    rows = [(i, "the cat sat on the mat") for i in range(40)] + [(100 + i, "the \u00a0 cat") for i in range(20)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect()}
    enc = lm.encoder(WORD, False)
    assert len(enc.encode_words(["\u00a0"])[0]) == 0 and math.isfinite(got[100].score)
    ids, n = lm.text_ids(enc, pa.array(["the \u00a0 cat".encode()], pa.binary()))
    assert ids.tolist()[-3:-1].count(enc.tokenizer.get_vocab_size() + 1) <= 1 and enc.tokenizer.get_vocab_size() + 1 in ids


def test_tasks_take_several_chunks(docs, monkeypatch):
    whole = {r.doc_id: r for r in lm.score_documents(docs, WORD, chunk_bytes=60_000).collect()}
    monkeypatch.setattr(lm, "MOST_TASKS", 2)
    monkeypatch.setattr(lm, "HELD", 1)
    again = lm.score_documents(docs, WORD, chunk_bytes=60_000).collect()
    assert len(again) == len(whole)
    for r in again:
        assert r[:5] == whole[r.doc_id][:5] and r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.score == pytest.approx(whole[r.doc_id].score, rel=1e-3)


def test_words_travel_in_rows_of_many_and_are_tokenized_once(monkeypatch):
    texts = [" ".join(f"w{(i * 7 + k) % 900}" for k in range(300)) + f" only{i}" + " <b" + "x" * 100 * (i == 0) for i in range(8)]
    held, chunk = [i % 4 == 1 for i in range(8)], [i // 2 for i in range(8)]
    kinds = {"chunk": pa.int32(), "held_out": pa.bool_(), "text": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((chunk, held, [t.encode() for t in texts]), kinds.values(), strict=True)], list(kinds))
    listed = pa.Table.from_batches(list(lm._words(3)(iter([batch]))))
    assert len(listed) <= 4 * 3  # a row for each chunk and part, not for each word
    tokenized, pool = [], lm.word_pool
    monkeypatch.setattr(lm, "word_pool", lambda enc, words: tokenized.extend(words.to_pylist()) or pool(enc, words))
    counted = pa.concat_tables(lm._counter(WORD)(listed.filter(pc.equal(listed["part"], k))) for k in range(3))
    assert Counter(tokenized) == Counter({w for t in texts for w in t.split()})
    want, enc, first = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t.split()), lm.encoder(WORD, False), Counter()
    for number in range(4):
        got = []
        for r in counted.filter(pc.equal(counted["chunk"], number)).to_pylist():
            words = [w.decode() for w in lm._from_raw([r["words"]], [r["sizes"]]).cast(pa.binary()).to_pylist()]
            assert np.frombuffer(r["c"], np.int64).tolist() == [want[w] for w in words]
            n = np.frombuffer(r["n_ids"], np.int32)
            ids = np.split(np.frombuffer(r["ids"], lm.id_type(enc)), np.cumsum(n)[:-1])
            assert [x.tolist() for x in ids] == [np.frombuffer(enc.encode(w), enc.dtype).tolist() for w in words]
            first.update(w for w, f in zip(words, np.frombuffer(r["first"], bool), strict=True) if f)
            got += words
        assert sorted(got) == sorted({w for t, c in zip(texts, chunk, strict=True) if c == number for w in t.split()})
    assert first == Counter(set(want))


def test_small_batches_are_for_the_jobs_inside(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), small_batches(spark, 7):
        sizes = spark.range(100).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
        assert max(r.n for r in sizes) == 7
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before


def test_language_model_of_nothing(no_docs):
    assert lm.score_documents(no_docs, WORD).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x7F), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_words_are_split_as_bytes_are(texts):
    words, sizes = lm.split_words(pa.array([t.encode() for t in texts], pa.binary()))
    expected = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(x) for x in expected]
    assert [w.encode() for w in words.to_pylist()] == [w for x in expected for w in x]
