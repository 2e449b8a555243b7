"""Operator 10: language-model scores from a small causal self-attention model.

The 1,023 most frequent subword ids of a public tokenizer are the symbols of the model, and one
more stands for all others. Symbols come in 32 classes of 32. One layer of causal
self-attention, trained in numpy, gives a state for each place; class, and symbol within the
class, are softmaxes over that state's scores plus the log share that corpus counts give them
after the symbol before in its word; pairs stop at word ends. An id under the last symbol has its share by smoothed counts. The
product is a probability over all ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import MOST_TASKS, chunk_parts, materialize, release_memory, small_batches, texts_by_bytes
from .encoding import encoder

CLASSES, WIDTH, WINDOW, STRIDE = 32, 16, 16, 8
SYMBOLS = CLASSES * CLASSES
BATCH = 512  # training windows a step
OTHER, START = SYMBOLS - 1, SYMBOLS  # all rarer ids; what stands before a text
PARAMS = {"E": (SYMBOLS + 1, WIDTH), "P": (WINDOW, WIDTH), "Wq": (WIDTH, WIDTH), "Wk": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH), "Wo": (WIDTH, WIDTH), "Uc": (WIDTH, CLASSES), "Us": (CLASSES, WIDTH, CLASSES)}
HELD = 4  # chunks whose words a task holds at once
PART_CHUNKS = 2  # chunks whose words are as many as those that are counted at once
_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW))) > 0, 0.0, -1e9).astype(np.float32)
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(CLASSES, np.float32)
_SCALE = np.float32(1 / math.sqrt(WIDTH))


# --- the model -----------------------------------------------------------------------------


class Prior:
    """Log shares by corpus counts: of classes, and of symbols within a class, by symbol before.

    pairs: (symbol before or START, symbol) counts. Shares after one symbol are smoothed towards
    the shares over all by the number of different symbols seen after it.
    """

    def __init__(self, pairs: np.ndarray):
        over_all = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * SYMBOLS)
        kinds = np.maximum(1, (pairs > 0).sum(1, keepdims=True))
        shares = (pairs + kinds * over_all) / (pairs.sum(1, keepdims=True) + kinds)
        classes = shares.reshape(-1, CLASSES, CLASSES).sum(2)
        self.classes = np.log(classes).astype(np.float32)
        # Class by class, since they are read in that order: a class's rows then stay in the cache.
        within = np.log(shares.reshape(-1, CLASSES, CLASSES) / classes[..., None]).astype(np.float32)
        self.symbols = np.ascontiguousarray(within.transpose(1, 0, 2)).reshape(-1, CLASSES)


def unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in PARAMS.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_params(seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    spread = {"E": 0.5, "P": 0.2, "Uc": 0.05, "Us": 0.05}
    return np.concatenate([r.normal(0, spread.get(k, WIDTH**-0.5), s).ravel() for k, s in PARAMS.items()]).astype(np.float32)


def _by_class(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal classes together, and where each class begins."""
    classes = (wanted // CLASSES).astype(np.int8)  # sorted by radix
    order = np.argsort(classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1, dtype=np.int8))


def _exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place; their sums over the last axis. Rows are shifted only where some exponent is
    large: the maximum of each row costs more than all the rest."""
    if z.size and z.max() > 60:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    return z @ _ONES[: z.shape[-1]]


def _softmax(z: np.ndarray) -> None:
    """In place, over the last axis."""
    z *= (1 / _exp(z))[..., None]


def loss_and_gradient(flat: np.ndarray, prior: Prior, given: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy over windows of symbols, and its gradient. wanted -1 is not counted;
    ``before`` is the row of the prior at each place."""
    p, windows = unflat(flat), (*given.shape, WIDTH)
    given, before, wanted = (z.astype(np.intp) for z in (given, before, wanted))
    x = p["E"].take(given, axis=0)
    x += p["P"]
    keys = x
    x = x.reshape(-1, WIDTH)
    # What Wq and Wk, and Wv and Wo, do one after the other, as one matrix each.
    heads = np.concatenate([p["Wq"] @ p["Wk"].T * _SCALE, p["Wv"] @ p["Wo"]], 1)
    q, v = np.split((x @ heads).reshape(*given.shape, 2 * WIDTH), 2, -1)
    a = q @ keys.transpose(0, 2, 1)
    a += _MASK
    _softmax(a)
    h = (a @ v).reshape(-1, WIDTH)
    h += x
    valid = np.flatnonzero(wanted.ravel() >= 0)
    order, edges = _by_class(wanted.ravel()[valid])
    valid = valid[order]
    t, row, state = wanted.ravel().take(valid), before.ravel().take(valid), h.take(valid, axis=0)
    n, place = max(1, len(t)), np.arange(len(t)) * CLASSES
    zc = state @ p["Uc"]
    zc += prior.classes.take(row, axis=0)
    zs, slices = np.empty_like(zc), [slice(*edges[c : c + 2]) for c in range(CLASSES)]
    for c, own in enumerate(slices):
        np.matmul(state[own], p["Us"][c], out=zs[own])
    zs += prior.symbols.take(t // CLASSES * (SYMBOLS + 1) + row, axis=0)
    loss = 0.0
    for z, at in ((zc, t // CLASSES), (zs, t % CLASSES)):
        each = place + at
        total = _exp(z)
        loss -= float(np.log(z.ravel().take(each) / total).sum()) / n
        z *= (1 / (total * n)).astype(z.dtype)[:, None]
        z.ravel()[each] -= 1 / n
    g = {"Uc": state.T @ zc, "Us": np.empty_like(p["Us"])}
    dstate, within = zc @ p["Uc"].T, np.empty_like(state)
    for c, own in enumerate(slices):
        np.matmul(state[own].T, zs[own], out=g["Us"][c])
        np.matmul(zs[own], p["Us"][c].T, out=within[own])
    dstate += within
    dh = np.zeros_like(h)
    dh[valid] = dstate
    do = dh.reshape(windows)
    da = do @ v.transpose(0, 2, 1)
    d = np.empty((*given.shape, 2 * WIDTH), h.dtype)
    np.matmul(a.transpose(0, 2, 1), do, out=d[..., WIDTH:])
    da *= a
    da -= a * (da @ _ONES[:WINDOW])[..., None]
    np.matmul(da, keys, out=d[..., :WIDTH])
    dx = (da.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
    d = d.reshape(-1, 2 * WIDTH)
    dqk, dvo = np.split(x.T @ d, 2, 1)
    dqk = dqk * _SCALE
    g |= {"Wq": dqk @ p["Wk"], "Wk": dqk.T @ p["Wq"], "Wv": dvo @ p["Wo"].T, "Wo": p["Wv"].T @ dvo}
    dx += d @ heads.T
    dx += dh
    g["P"] = dx.reshape(windows).sum(0)
    order = np.argsort(given.ravel().astype(np.int16), kind="stable")  # sorted by radix
    same = given.ravel().take(order)
    begins = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    g["E"] = np.zeros_like(p["E"])
    g["E"][same[begins]] = np.add.reduceat(dx.take(order, axis=0), begins, axis=0)
    return loss, np.concatenate([g[name].ravel() for name in PARAMS]).astype(np.float32, copy=False)


def fit(flat: np.ndarray, prior: Prior, batches: Iterator[tuple], rate: float) -> tuple[np.ndarray, int, int]:
    """Adam over the batches; the parameters, and how many windows and ids were predicted."""
    flat, m, v, n, ids = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for step, (given, before, wanted) in enumerate(batches, 1):
        _, g = loss_and_gradient(flat, prior, given, before, wanted)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        n += len(given)
        ids += int((wanted >= 0).sum())
    return flat, n, ids


class Symbols:
    """What ids mean to the model.

    symbol: by id. row: of the prior, after a symbol; one that ends a word leads to START. rare:
    log10 share under OTHER, by id.
    """

    def __init__(self, counts: np.ndarray, ends_word: np.ndarray):
        top = np.argsort(-counts, kind="stable")[: SYMBOLS - 1]
        self.symbol = np.full(len(counts), OTHER, np.int32)
        self.symbol[top] = np.arange(len(top))
        self.row = np.arange(SYMBOLS + 1, dtype=np.int32)
        self.row[:OTHER][: len(top)][ends_word[top]] = START
        rest = np.where(self.symbol == OTHER, counts + 0.5, 0)
        self.rare = np.log10(rest / rest.sum(), where=rest > 0, out=np.zeros(len(counts)))


class Scorer:
    """log10 probabilities of id sequences under trained parameters."""

    def __init__(self, flat: np.ndarray, prior: Prior, symbols: Symbols):
        p = unflat(flat)
        # By symbol and by place; one more column of values sums the weights of attention.
        ones, none = np.ones((SYMBOLS + 1, 1), np.float32), np.zeros((WINDOW, 1), np.float32)
        wv = p["Wv"] @ p["Wo"]
        self.x, self.q, self.k = ((p["E"], p["P"]), (p["E"] @ p["Wq"] * _SCALE, p["P"] @ p["Wq"] * _SCALE), (p["E"] @ p["Wk"], p["P"] @ p["Wk"]))
        self.v = np.c_[p["E"] @ wv, ones], np.c_[p["P"] @ wv, none]
        self.Uc, self.Us, self.prior, self.symbols = p["Uc"], p["Us"], prior, symbols

    def symbol_logs(self, given: np.ndarray, wanted: np.ndarray, pick: np.ndarray, skip: int = 0) -> np.ndarray:
        """Natural logs at the picked places of the windows, in order. The first ``skip`` places are
        context alone; ``wanted`` and ``pick`` begin after them."""
        late = given[:, skip:]
        q, k, v = self.q[0].take(late, axis=0), self.k[0].take(given, axis=0), self.v[0].take(given, axis=0)
        q += self.q[1][skip:]
        k += self.k[1]
        v += self.v[1]
        s = q @ k.transpose(0, 2, 1)
        if s.max() > 60:
            s -= (s + _MASK[skip:]).max(-1, keepdims=True)
        np.exp(s, out=s)
        s *= _CAUSAL[skip:]
        o = (s @ v).reshape(-1, WIDTH + 1)
        order, edges = _by_class(np.where(pick, wanted, SYMBOLS).ravel())  # what is not picked comes last
        order = order[: edges[CLASSES]]
        o = o.take(order, axis=0)
        state = o[:, :WIDTH] * (1 / o[:, WIDTH:])
        last = late.ravel().take(order)
        state += self.x[0].take(last, axis=0)
        state += self.x[1].take(order % (WINDOW - skip) + skip, axis=0)
        t, row = wanted.ravel().take(order), self.symbols.row.take(last)
        zs = np.empty((len(t), CLASSES), np.float32)
        for c in range(CLASSES):
            np.matmul(state[edges[c] : edges[c + 1]], self.Us[c], out=zs[edges[c] : edges[c + 1]])
        zs += self.prior.symbols.take(t // CLASSES * (SYMBOLS + 1) + row, axis=0)
        zc = state @ self.Uc
        zc += self.prior.classes.take(row, axis=0)
        place, logs = np.arange(len(t)) * CLASSES, np.zeros(len(t), np.float32)
        for z, which in ((zc, t // CLASSES), (zs, t % CLASSES)):
            if len(z) and z.max() > 60:
                z -= z.max(-1, keepdims=True)
            logs += z.ravel().take(place + which)
            np.exp(z, out=z)
            logs -= np.log(z @ _ONES)
        out = np.empty(pick.size, np.float32)
        out[order] = logs
        return out[pick.ravel()]

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each sequence (none is empty)."""
        return self.score_flat(np.concatenate(sequences).astype(np.int64), np.array([len(s) for s in sequences]))

    def score_flat(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for sequences of the given sizes, one after the other."""
        return np.add.reduceat(self.id_logs(ids, sizes), np.cumsum(sizes) - sizes)

    def id_logs(self, ids: np.ndarray, sizes: np.ndarray, step: int = 1024) -> np.ndarray:
        """The log10 probability of each id in its sequence. Windows overlap, so that an id past the
        first window has WINDOW - STRIDE ids of context or more; each is scored once."""
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes
        wanted = self.symbols.symbol.take(ids)
        given = np.empty_like(wanted)
        given[1:] = wanted[:-1]
        given[starts] = START
        more = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        number = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        later = np.repeat(starts, more) + (number + 1) * STRIDE
        logs = np.empty(len(ids))
        for first, last, skip in ((starts, ends, 0), (later, np.repeat(ends, more), WINDOW - STRIDE)):
            for a in range(0, len(first), step):
                place = first[a : a + step, None] + np.arange(WINDOW)
                own = place[:, skip:]
                pick = own < last[a : a + step, None]
                np.minimum(place, len(ids) - 1, out=place)
                logs[own[pick]] = self.symbol_logs(given.take(place), wanted.take(own), pick, skip)
        logs *= 1 / math.log(10)
        logs += self.symbols.rare.take(ids)
        return logs


# --- what is gathered from the corpus ------------------------------------------------------


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id counts as empty text, so it is trained on."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of binary texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    filled = pc.greater(pc.binary_length(lists.values), 0)  # white space at an edge leaves an empty word
    before = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))
    return lists.values.filter(filled), np.diff(before[lists.offsets.to_numpy()])


def _raw(words: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of an array of words, and their lengths as int32."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return memoryview(words.buffers()[2])[ends[0] : ends[-1]].tobytes() if len(words) else b"", np.diff(ends).tobytes()


def _blobs(raw: bytes, edges: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``raw`` as binary values."""
    wide = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
    return wide.cast(pa.binary())


def _from_raw(words: list[bytes], sizes: list[bytes]) -> pa.Array:
    """The words of one or more pieces of ``_raw``."""
    ends = np.append(0, np.cumsum(np.frombuffer(b"".join(sizes), np.int32)))
    if ends[-1] >= 1 << 31:
        raise ValueError("the words of a part or chunk take 2 GB or more")
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(words)))


def _parts(words: pa.Array, parts: int, step: int = 50_000) -> np.ndarray:
    """A number under ``parts`` for each word (none is empty), from its length and its first 64 bytes."""
    powers, out = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64)), [np.zeros(0, np.int64)]
    for i in range(0, len(words), step):
        some = words.slice(i, step).cast(pa.binary())
        heads = pc.binary_slice(some, 0, 64)
        raw, sizes = (np.frombuffer(x, k) for x, k in zip(_raw(heads), (np.uint8, np.int32), strict=True))
        starts = np.cumsum(sizes) - sizes
        h = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(starts, sizes)], starts)
        h += pc.binary_length(some).to_numpy().astype(np.uint64)
        h ^= h >> np.uint64(32)
        out.append((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % parts)
    return np.concatenate(out)


_LISTED = "part int, chunk int, words binary, sizes binary, n binary"


def _words(parts: int) -> Callable:
    """To (part, chunk, words, sizes, n): every distinct word of a chunk, with its count in training texts,
    dealt to parts by the word. A row has many words, one after the other. A chunk whose rows come far
    apart is listed in pieces."""

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[pa.Array], list[pa.Array]]] = {}  # words of training texts, of others

        def out() -> Iterator[pa.RecordBatch]:
            for chunk, (trained, others) in held.items():
                counted = pa.chunked_array(trained, pa.string()).value_counts()
                words = counted.field("values")
                unseen = pa.chunked_array(others, pa.string()).unique()
                unseen = unseen.filter(pc.invert(pc.is_in(unseen, value_set=words)))
                n = np.append(counted.field("counts").to_numpy(), np.zeros(len(unseen), np.int64))
                words = pa.concat_arrays([words, unseen])
                part = _parts(words, parts)
                order = np.argsort(part, kind="stable")
                words, n, part = words.take(pa.array(order)), n[order], part[order]
                begins = np.flatnonzero(np.diff(part, prepend=-1))
                edges = np.append(begins, len(part))
                raw, sizes = _raw(words)
                ends = np.append(0, np.cumsum(np.frombuffer(sizes, np.int32)))
                blobs = [_blobs(x, at) for x, at in ((raw, ends[edges]), (sizes, edges * 4), (n.tobytes(), edges * 8))]
                numbers = pa.array(part[begins], pa.int32()), pa.array(np.full(len(begins), chunk, np.int32))
                yield pa.RecordBatch.from_arrays([*numbers, *blobs], ["part", "chunk", "words", "sizes", "n"])
            held.clear()
            release_memory()

        for number, own in chunk_parts(batches):
            if number not in held and len(held) >= HELD:
                yield from out()
            both = held.setdefault(number, ([], []))
            for is_other, into in enumerate(both):
                part = own.filter(pc.equal(own.column("held_out"), bool(is_other)))
                for i, j in texts_by_bytes(part, "text"):
                    into.append(split_words(part.column("text").slice(i, j - i))[0])
        yield from out()

    return list_words


_COUNTED = "chunk int, words binary, sizes binary, c binary, first binary, ids binary, n_ids binary"


def _counter(path: str) -> Callable:
    """The rows of one part, of all chunks, with each word's count over all training texts (c), its ids,
    and in ``first`` a 1 once for each word of a training text. A word is tokenized once for all chunks."""

    def count(listed: pa.Table) -> pa.Table:
        listed = listed.sort_by("chunk")
        raw, sizes, n = (listed.column(x).to_pylist() for x in ("words", "sizes", "n"))
        coded = _from_raw(raw, sizes).dictionary_encode()
        where, every = coded.indices.to_numpy(), coded.dictionary
        c = np.bincount(where, weights=np.frombuffer(b"".join(n), np.int64), minlength=len(every)).astype(np.int64)
        first, at = np.zeros(len(where), bool), np.zeros(len(every), np.int64)
        at[where[::-1]] = np.arange(len(where))[::-1]
        first[at] = c > 0
        pool = word_pool(encoder(path, False), every)
        rows, done = [], 0
        for a, b, x in zip(raw, sizes, listed.column("chunk").to_pylist(), strict=True):
            own = slice(done, done := done + len(b) // 4)
            numbers = where[own] + 1  # 0 is the end of a text
            ids, n_ids = joined_ids(pool, numbers, np.arange(len(numbers)))
            rows.append((x, a, b, c[where[own]].tobytes(), first[own].tobytes(), ids.tobytes(), n_ids.astype(np.int32).tobytes()))
        del coded, where, every, c, first, pool
        release_memory()
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        return pa.Table.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows, strict=True))], names)

    return count


def id_type(enc) -> np.dtype:
    """Of ids, of the end of a text, numbered after all of them, and of a word without ids, after that."""
    return np.dtype("<u2" if enc.tokenizer.get_vocab_size() + 2 <= 1 << 16 else "<u4")


def word_pool(enc, words: pa.Array, step: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the end of a text and of each word, one after the other; where each begins; and how
    many each has. A word that the tokenizer has no ids for has one of its own, the same for all."""
    end, dtype = enc.tokenizer.get_vocab_size(), id_type(enc)
    parts, sizes = [np.array([end], dtype)], [np.ones(1, np.int64)]
    for i in range(0, len(words), step):
        ids, n = enc.encode_word_array(words.slice(i, step))
        none = np.flatnonzero(n == 0)
        if len(none):
            ids = np.insert(ids.astype(dtype, copy=False), (np.cumsum(n) - n)[none], end + 1)
            n[none] = 1
        parts.append(ids.astype(dtype, copy=False))
        sizes.append(n)
    lengths = np.concatenate(sizes)
    return np.concatenate(parts), np.cumsum(lengths) - lengths, lengths


def joined_ids(pool: tuple[np.ndarray, np.ndarray, np.ndarray], numbers: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given as numbers of a pool's words, the texts beginning at ``firsts``, and how
    many each has."""
    ids, begins, lengths = pool
    n = lengths[numbers]
    place = np.repeat(begins[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return ids.take(place), np.add.reduceat(n, firsts)


def text_ids(enc, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of binary texts, one after the other, each with its end, and how many each has."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    numbers = np.insert(coded.indices.to_numpy().astype(np.int64) + 1, np.cumsum(sizes), 0)  # 0 is the end of a text
    sizes = sizes + 1
    ids, n = joined_ids(word_pool(enc, coded.dictionary), numbers, np.cumsum(sizes) - sizes)
    return ids.astype(np.int64), n


def training_windows(ids: np.ndarray, sizes: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """(given, wanted): windows that follow each other over the whole of each text of ``sizes`` ids,
    so that every id is wanted once. Places past the end of a text want -1."""
    starts = np.cumsum(sizes) - sizes
    wanted = symbols.symbol.take(ids)
    given = np.empty_like(wanted)
    given[1:] = wanted[:-1]
    given[starts] = START
    windows = -(-sizes // WINDOW)
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    place = (np.repeat(starts, windows) + number * WINDOW)[:, None] + np.arange(WINDOW)
    inside = place < np.repeat(starts + sizes, windows)[:, None]
    place = np.minimum(place, len(ids) - 1)
    return given.take(place), np.where(inside, wanted.take(place), np.int32(-1))


def _sequences(batch: pa.RecordBatch, dtype: np.dtype, step: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``step`` ids each, one row at least, with their ids and sizes."""
    for i, j in texts_by_bytes(batch, "ids", step * dtype.itemsize):
        part = batch.slice(i, j - i)
        ids = part.column("ids")
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if pa.types.is_binary(ids.type) else np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype)
        yield part, flat.astype(np.int32), np.diff(at).astype(np.int64) // dtype.itemsize


def _trainer(dtype: np.dtype, flat: np.ndarray, shared, rate: float, fewest: int) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, symbols = shared.value
        shard, held, seen, order = 0, [], 0, np.random.default_rng(5)

        def feed() -> Iterator[tuple]:
            nonlocal shard, seen
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column("shard")[0].as_py()
                for _, ids, sizes in _sequences(batch, dtype):
                    given, wanted = training_windows(ids, sizes, symbols)
                    mixed = order.permutation(len(given))
                    for at in range(0, len(mixed), BATCH):
                        own = mixed[at : at + BATCH]
                        some = given.take(own, axis=0)
                        part = some, symbols.row.take(some), wanted.take(own, axis=0)
                        seen += 1
                        if len(held) < fewest:
                            held.append(part)
                        yield part
            while held and seen < fewest:  # a small shard goes round until it has made enough steps
                for part in held:
                    seen += 1
                    yield part

        trained, n, ids = fit(flat, prior, feed(), rate)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.int64()), pa.array([trained.tobytes()], pa.binary())], ["shard", "n", "ids", "params"])

    return train


def train(texts: DataFrame, dtype: np.dtype, shared, shard_ids: int = 6 << 20, most: int = 512, rates: tuple[float, ...] = (0.02, 0.006), fewest: int = 200) -> tuple[np.ndarray, int]:
    """Parameters after one pass over all of ``place, ids``, in rounds of training in each shard and
    averaging, weighted by windows; and how many ids were predicted. Each round takes whole texts
    of its own, so every id is predicted once, but in shards of under ``fewest`` steps, which
    repeat their own.

    A shard holds about ``shard_ids``, more where that would make over ``most`` of them. The
    driver gets one row of some 140 KB a shard and round, at any size of the corpus.
    """
    size = (texts.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // dtype.itemsize
    shards = max(1, min(most, size // shard_ids))
    flat, done = first_params(), 0
    dealt = texts.select("ids", "place", F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards} % {len(rates)}").alias("round"))
    for number, rate in enumerate(rates):
        own = dealt.where(F.col("round") == number).repartitionById(shards, "shard").sortWithinPartitions("place", "ids")
        rows = own.select("shard", "ids").mapInArrow(_trainer(dtype, flat, shared, rate, fewest), "shard int, n long, ids long, params binary").collect()
        if not rows:
            continue
        rows.sort(key=lambda r: r.shard)
        total, done = sum(r.n for r in rows), done + sum(r.ids for r in rows)
        flat = sum(np.frombuffer(r.params, np.float32).astype(np.float64) * (r.n / total) for r in rows).astype(np.float32)
    return flat, done


# --- scoring -------------------------------------------------------------------------------


_ENCODED = "held_out boolean, place long, n_tokens long, n_known long, base_sum double, ids binary, before long, id long, n long"


def _encoder(dtype: np.dtype, end_id: int, end_count: int, doc_id: pa.DataType) -> Callable:
    """The texts of a chunk and its words as ``_counter`` gives them to rows of two sorts: documents, and what the first
    words add to counts of ids by the id before (-1 before a word's first), to all words (-2, 0)
    and to distinct ones (-2, 1)."""
    names = [x.split()[0] for x in _ENCODED.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema([("doc_id", doc_id), *zip(names, kinds, strict=True)])

    def rows(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def encode(texts: pa.Table, counted: pa.Table) -> pa.Table:
        parts, listed, out = [], [pa.array([], pa.string())], []
        for batch in texts.to_batches():
            for i, j in texts_by_bytes(batch, "text", 1 << 20):
                some = batch.slice(i, j - i)
                words, sizes = split_words(some.column("text"))
                listed.append(words)
                parts.append((some, sizes))
        raw = {x: counted.column(x).to_pylist() for x in counted.column_names if x != "chunk"}
        known = _from_raw(raw["words"], raw["sizes"])
        # A word can come twice, if its chunk was listed in pieces; the first of it is found.
        numbers = pc.index_in(pa.concat_arrays(listed), value_set=known)
        if numbers.null_count:
            raise ValueError("a word of this chunk was not listed")
        numbers = numbers.to_numpy()
        del listed, known
        # Number 0 is the end of a text, then come the words.
        c, first, ids, n = (np.append(np.array([x], k), np.frombuffer(b"".join(raw[y]), k)) for x, k, y in ((end_count, np.int64, "c"), (False, bool, "first"), (end_id, dtype, "ids"), (1, np.int32, "n_ids")))
        n = n.astype(np.int64)
        logs, pool = np.log10(c + 0.5), (ids, np.cumsum(n) - n, n)
        del raw

        own = np.flatnonzero(first)
        if len(own):
            ids, n = joined_ids(pool, own, np.arange(len(own)))
            flat, ends = ids.astype(np.int64), np.cumsum(n)
            before = np.append(-1, flat[:-1])
            before[ends - n] = -1
            code, which = np.unique((before + 1) << 32 | flat, return_inverse=True)
            weight = np.bincount(which, weights=np.repeat(c[own], n)).astype(np.int64)
            both = [np.append((code >> 32) - 1, [-2, -2]), np.append(code & 0xFFFFFFFF, [0, 1]), np.append(weight, [c[own].sum(), len(own)])]
            out.append(rows(len(both[0]), dict(zip(("before", "id", "n"), map(pa.array, both), strict=True))))

        done = 0
        for some, sizes in parts:
            words = np.insert(numbers[done : done + int(sizes.sum())].astype(np.int64) + 1, np.cumsum(sizes), 0)
            done, sizes = done + int(sizes.sum()), sizes + 1
            begins = np.cumsum(sizes) - sizes
            ids, n = joined_ids(pool, words, begins)
            edges = np.append(0, np.cumsum(n) * ids.itemsize)
            coded_ids = _blobs(ids.tobytes(), edges)
            found = {"n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(np.add.reduceat((c[words] > 0).astype(np.int64), begins)), "base_sum": pa.array(np.add.reduceat(logs[words], begins)), "ids": coded_ids}
            out.append(rows(len(sizes), found | {x: some.column(x) for x in ("doc_id", "held_out", "place")}))
        del pool, parts, c, first, ids, n, logs, numbers
        release_memory()  # a worker lives on, and trains and scores later
        return pa.Table.from_batches(out, schema)

    return encode


def _scorer(dtype: np.dtype, shared, flat: np.ndarray) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(flat, *shared.value)
        for batch in batches:
            for part, ids, sizes in _sequences(batch, dtype):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_sum")], pa.array(model.score_flat(ids, sizes))], ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score"])

    return score


def score_documents(docs: DataFrame, tokenizer: str, chunk_bytes: int = 12 << 20) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents are dealt to chunks of about ``chunk_bytes`` of text by a hash, chunks to a bounded number
    of tasks, which take theirs one after the other. Each chunk lists its words, in rows of many words dealt to parts by the word. A part counts its words over all training
    texts and tokenizes each once, and sends them back, so a chunk gets the counts and ids of its own words, however large
    the vocabulary. One Arrow stage, which holds a chunk, encodes its texts and writes their ids; texts are shuffled once for both. The model is then trained on all ids of all
    training documents and scores all documents from those, both in streams of batches. Subword
    counts and word counts come from all training documents.

    A null text is empty: its end token alone is scored. A null id is trained on. Repeated rows
    count and are scored each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    all_ = docs.select("doc_id", is_held_out().alias("held_out"), text.alias("text"))
    stats = all_.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("train")).first()
    chunks, train_docs = max(1, math.ceil((stats.bytes or 0) / chunk_bytes)), stats.train or 0
    tasks = min(chunks, MOST_TASKS)
    keyed = all_.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).withColumn("chunk", F.pmod("place", F.lit(chunks)).cast("int")).repartition(tasks, "chunk")

    # The words of a chunk go in rows of many words, dealt by the word, to be counted over all chunks, and back to it.
    parts = -(-chunks // PART_CHUNKS)
    listed = keyed.mapInArrow(_words(parts), _LISTED).repartition(min(parts, MOST_TASKS), "part")
    counted = listed.groupBy("part").applyInArrow(_counter(tokenizer), _COUNTED)
    both = keyed.groupBy("chunk").cogroup(counted.groupBy("chunk"))
    enc = encoder(tokenizer, False)
    dtype = id_type(enc)
    encode = _encoder(dtype, enc.tokenizer.get_vocab_size(), train_docs, to_arrow_type(docs.schema["doc_id"].dataType))
    with small_batches(spark):  # texts, and rows of many words
        stored = materialize(both.applyInArrow(encode, f"doc_id {kind}, {_ENCODED}"), "ids")
    encoded, pairs = stored.where("before is null"), stored.where("before is not null").groupBy("before", "id").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "pairs")
    sums = {r.id: r.n for r in pairs.where("before = -2").collect()}
    train_tokens, distinct = sums.get(0, 0) + train_docs, sums.get(1, 0) + (train_docs > 0)

    prior, symbols = _gathered(pairs.where("before > -2"), tokenizer, train_docs)
    shared = spark.sparkContext.broadcast((prior, symbols))
    with small_batches(spark, 2000):
        flat, _ = train(encoded.where(~F.col("held_out")), dtype, shared)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_sum"]
    scored = encoded.select(*columns, "ids").mapInArrow(_scorer(dtype, shared, flat), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_sum double, score double")
    base = F.col("base_sum") - F.col("n_tokens") * math.log10(train_tokens + 0.5 * (distinct + 1))
    return scored.select(*columns[:-1], F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _gathered(pairs: DataFrame, tokenizer: str, train_docs: int) -> tuple[Prior, Symbols]:
    """The prior and the symbols, from (before, id, n) of all training words. The driver sees one row
    per id, then one per pair of symbols: at most 1,025 times 1,024, whatever the corpus."""
    tok = encoder(tokenizer, False).tokenizer
    size = tok.get_vocab_size()
    counts = np.zeros(size + 2)
    for r in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    counts[size] = train_docs  # the end of a text
    ends = np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(size)] + [True, True])
    symbols = Symbols(counts, ends)
    row, symbol = np.append(symbols.row[symbols.symbol], START), symbols.symbol  # row[-1]: before a word
    to = pairs.sparkSession.createDataFrame([(i, int(row[i]), int(symbol[i])) for i in range(-1, size + 2)], "id long, row int, symbol int")
    known = pairs.join(F.broadcast(to.select(F.col("id").alias("before"), "row")), "before").join(F.broadcast(to.select("id", "symbol")), "id")
    table = np.zeros((SYMBOLS + 1, SYMBOLS))
    found = known.groupBy("row", "symbol").agg(F.sum("n").alias("n")).toPandas()
    table[found["row"].to_numpy(np.int64), found["symbol"].to_numpy(np.int64)] = found["n"]
    table[START, symbol[size]] += train_docs
    return Prior(table), symbols
