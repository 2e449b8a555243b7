"""Operators 3, 4 and 6 against whole-text encoding with the library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keyloom.llm import packing, records, token_counts
from keyloom.llm.common import fresh_path
from keyloom.llm.encoding import TextEncoder, segments
from keyloom.llm.queries import packed

from .conftest import odd_texts

WORD, BYTE = str(P.path("word_bpe_49k.json")), str(P.path("byte_bpe_50k.json"))
LIB = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENC = {WORD: TextEncoder(WORD, False, segment=40), BYTE: TextEncoder(BYTE, True, segment=40)}


def ids_of(path, text):
    return LIB[path].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


piece = st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "\xa0", "é", "é", "́", "'s", "'", "don't", "12", ".", ",", "漢", "😀", "İ", "Σ", "σς", "<|endoftext|>", "<|", "ß", "ŉ", "ǆ", "‍", "x" * 50])


@settings(max_examples=400, deadline=None)
@given(st.lists(piece, max_size=30).map("".join), st.text(max_size=40))
def test_ids_are_the_library_s(text, other):
    for path, enc in ENC.items():
        for got, t in zip(enc.encode_batch([text, other, text + " " + other]), [text, other, text + " " + other], strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == ids_of(path, t)


@settings(max_examples=600, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_latin_texts(text):
    for path, enc in ENC.items():
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(path, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\t\n\x0b\x0c\r "), max_size=8), max_size=8))
def test_words(words):
    got = [np.frombuffer(x, "<u2").tolist() for x in ENC[WORD].encode_words(words)]
    flat, n = ENC[WORD].encode_word_array(pa.array(words, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == got if words else len(flat) == len(n) == 0
    assert got == [ids_of(WORD, w) for w in words]


def test_words_of_the_tables(docs):
    """Every text of the small table, and every stretch of one letter, against the library."""
    texts = [r.text for r in docs.collect()] + [c * n for c in "abehlorstzéß#.,!-=1" for n in range(1, 40)]
    for path, enc in ENC.items():
        for t in texts:
            assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids_of(path, t)


def test_segments_are_whole():
    text = " ".join(["word"] * 1000)
    parts = [p for p, _ in segments(text, 100)]
    assert len(parts) > 10 and " ".join(parts) == text
    assert list(segments("x" * 1000, 10)) == [("x" * 1000, True)]


def test_token_counts(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = sorted(map(tuple, token_counts.token_counts(df, WORD, limit=100).collect()), key=repr)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 100) for r in df.collect() for n in [len(ids_of(WORD, r.text))]), key=repr)
        assert got == want
    assert token_counts.token_counts(no_docs, WORD).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    rows = packed(df).collect()
    want = defaultdict(int)
    for r in df.collect():
        ids = [*ids_of(WORD, r.text), 1]
        want[r.doc_id, tuple(ids)] += 1
    tokens = sum(len(k[1]) * n for k, n in want.items())
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    assert sum(r.length for r in rows) == tokens
    if which == "docs":  # ids are unique: every piece against its document
        ids = {k[0]: k[1] for k in want}
        seen = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert seen[r.doc_id] == r.start and r.doc_tokens == len(ids[r.doc_id])
            seen[r.doc_id] += r.length
            assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert seen == {k: len(v) for k, v in ids.items()}
        assert tokens / (2048 * len(by)) > 0.97


def test_sequences_hold_their_pieces(docs):
    pieces = packing.pack_documents(docs.limit(20), WORD)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_differencing_is_near_equal():
    r = random.Random(0)
    sizes = np.array([r.randrange(1, 400) for _ in range(500)])
    window = packing.karmarkar_karp(sizes, 50)
    sums = np.bincount(window, sizes, 50)
    assert sums.max() - sums.min() <= 20
    assert packing.karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2).size == 5
    window, k = packing.balanced_windows(np.array([1500] * 5), 2048)
    assert k == 5 and np.bincount(window).tolist() == [1] * 5


def test_packing_of_nothing(no_docs):
    assert packed(no_docs).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_records(which, request, spark):
    df = request.getfixturevalue(which)
    manifest = records.write_records(df, fresh_path(spark, "records"), BYTE, files=3)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in records.read_records(manifest).collect()]
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.doc_id, np.array([*ids_of(BYTE, r.text), 2], "<u4").tobytes()) for r in df.collect()), key=lambda x: x[:2])
    got.sort(key=lambda x: x[1])
    assert [x[0] for x in got] == [x[2] for x in want]
    assert sorted(x[2] for x in got) == sorted(x[3] for x in want)
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    if which == "docs":
        assert [x[2] for x in got] == [x[3] for x in want]
        first = records.record_files(spark, manifest)[0]
        doc, ids = records.read_at(first, 5)
        assert (doc, ids.tobytes()) == (got[5][0], got[5][2])


def test_records_of_nothing(spark, no_docs):
    assert records.read_records(records.write_records(no_docs, fresh_path(spark, "records"), BYTE)).count() == 0


def test_damage_is_found():
    import io

    body = records.pack_body(None, np.arange(5, dtype="<u2"))
    out = bytearray(records.frame(body))
    doc, ids = records.unpack_body(records.read_frame(io.BytesIO(bytes(out))))
    assert doc is None and ids.tolist() == [0, 1, 2, 3, 4]
    for at in range(len(out)):
        bad = bytearray(out)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(bytes(out[:-1])))


def test_odd_texts_are_odd():
    assert len(odd_texts()) > 25
