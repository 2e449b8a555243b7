"""Operator 9: SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks; of two fingerprints that differ in t bits, one of k blocks
holds t // k of them or fewer. In each block the anchors are the words of a covering code: a
perfect Hamming code, of covering radius 1, on as many bits as it takes, and all values on the
others, of covering radius 0. A fingerprint is at home at its nearest anchor, and goes to every
anchor within covering radius plus block threshold. So for each linked pair the home anchor of
either holds both, and pairs are compared there in full.

The code grows with the corpus: three blocks with the [15, 11] code put 42 copies of a
fingerprint to 3 * 2^18 anchors or less; beyond ``MANY`` fingerprints, two blocks with the [31, 26] code
put 344 copies to 2^28 anchors, so that an anchor's members stay few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, materialize, texts_by_bytes
from .components import connected_components


@dataclass(frozen=True)
class Layout:
    """blocks: (lowest bit, bits). check_bits: of the Hamming code on the low bits of each."""

    blocks: tuple[tuple[int, int], ...]
    check_bits: int

    @property
    def code_bits(self) -> int:
        return (1 << self.check_bits) - 1


THREE = Layout(((0, 22), (22, 21), (43, 21)), 4)
TWO = Layout(((0, 32), (32, 32)), 5)
#: Fingerprints beyond which copying them to more anchors costs less than comparing them.
MANY = 100_000_000
#: Members of an anchor from which on it is split.
HOT = 20_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned; a bit is 1 if it is set in over half the hashes. 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in texts_by_bytes(batch, "text"):
            part = batch.slice(a, b - a)
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(found)], ["doc_id", "hash", "fp"])


def _syndromes(code: np.ndarray, check_bits: int) -> np.ndarray:
    """The exclusive or of the numbers (from 1) of a word's set bits; 0 for a codeword."""
    out = np.zeros(len(code), np.int64)
    for i in range(check_bits):
        checked = sum(1 << bit for bit in range((1 << check_bits) - 1) if (bit + 1) >> i & 1)
        out |= (np.bitwise_count(code & checked) & 1).astype(np.int64) << i
    return out


@cache
def _reach(check_bits: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the error patterns of weight 1 + slack or less that lead to a codeword, the
    lightest first, padded with -1; and their weights."""
    by: list[list[int]] = [[] for _ in range(1 << check_bits)]
    for weight in range(slack + 2):
        for bits in combinations(range((1 << check_bits) - 1), weight):
            s = 0
            for bit in bits:
                s ^= bit + 1
            by[s].append(sum(1 << bit for bit in bits))
    wide = max(map(len, by))
    table = np.array([x + [-1] * (wide - len(x)) for x in by])
    return table, np.array([[bin(e).count("1") if e >= 0 else 99 for e in x] for x in table.tolist()])


def anchors(fp: np.ndarray, threshold: int, layout: Layout = THREE) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fp``, place) for every anchor a fingerprint goes to; a place is twice the
    anchor's number, plus 1 at home."""
    unsigned, index, place = fp.view(np.uint64), [], []
    slack = threshold // len(layout.blocks)
    table, weight = _reach(layout.check_bits, slack)
    for number, (low, bits) in enumerate(layout.blocks):
        part = (unsigned >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
        code, free = part & ((1 << layout.code_bits) - 1), part >> layout.code_bits
        syndrome = _syndromes(code, layout.check_bits)
        for flips in range(min(slack, bits - layout.code_bits) + 1):
            for turned in combinations(range(bits - layout.code_bits), flips):
                other = free ^ sum(1 << b for b in turned)
                for k in range(table.shape[1]):
                    # Covering radius 1 on the code bits; what the other bits used of the threshold is gone.
                    ok = np.flatnonzero(weight[syndrome, k] <= 1 + slack - flips)
                    word = code[ok] ^ table[syndrome[ok], k]
                    index.append(ok)
                    place.append((((number << 32 | other[ok] << layout.code_bits) | word) << 1) | (flips == 0 and k == 0))
    return np.concatenate(index), np.concatenate(place)


def _spread(threshold: int, layout: Layout, step: int = 5000):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), step):
                some = fp[at : at + step]
                index, place = anchors(some, threshold, layout)
                yield pa.RecordBatch.from_arrays([pa.array(place >> 1), pa.array((place & 1).astype(bool)), pa.array(some[index])], ["anchor", "home", "fp"])

    return spread


def group_links(group: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links among rows sorted by (group, fp): pairs of a home row and a later
    member of its group that differ in ``threshold`` bits or fewer, and their closure. At most
    about ``step`` pairs are held at once, and no row is in more than one link that leaves here."""
    n = len(fp)
    label = np.arange(n)
    last = np.searchsorted(group, group, side="right")
    homes = np.flatnonzero(home)
    todo = last[homes] - homes - 1
    homes, todo = homes[todo > 0], todo[todo > 0]
    bits = fp.view(np.uint64)
    at = 0
    total = np.cumsum(todo)
    while at < len(homes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        h, k = homes[at:end], todo[at:end]
        left = np.repeat(h, k)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        near = np.bitwise_count(bits[left] ^ bits[right]) <= threshold
        left, right = left[near], right[near]
        while len(left):
            a, b = label[left], label[right]
            apart = a != b
            left, right = left[apart], right[apart]
            least = np.minimum(a, b)[apart]
            np.minimum.at(label, a[apart], least)
            np.minimum.at(label, b[apart], least)
            while not np.array_equal(up := label[label], label):
                label = up
        at = end
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _compare(threshold: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            group = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            number = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(cols[0])]))
            a, b = group_links(number, cols[2], cols[3], threshold)
            apart = a != b  # a fingerprint can be in a cell as a home row and as a member
            a, b = a[apart], b[apart]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "home", "fp")]
            if not len(cols[0]):
                continue
            if kept:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            ends = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut:
                yield out([c[:cut] for c in cols])
            kept = [c[cut:] for c in cols]
        if kept:
            yield out(kept)

    return compare


def near_links(fingerprints: DataFrame, threshold: int = 4, layout: Layout = THREE) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of the distinct ``fp`` at ``threshold``
    or fewer differing bits.

    A hot anchor becomes a square of cells: each home row goes to the cells of its row, each
    member to those of its column, so that every home meets every member and no cell holds more
    than about ``HOT`` of either. The hot anchors are a stored table of one row per anchor of over
    ``HOT`` members.
    """
    spread = fingerprints.mapInArrow(_spread(threshold, layout), "anchor long, home boolean, fp long")
    hot = materialize(spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.ceil(F.col("n") / HOT).cast("long").alias("parts")), "hot")
    if hot.isEmpty():
        dealt = spread.withColumn("salt", F.lit(0).cast("long"))
    else:
        dealt = spread.join(hot, "anchor", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
        all_, own = "sequence(0L, parts - 1)", "case when parts is null then array(struct(0L as salt, home as home)) else {} end"
        cells = f"concat(if(home, transform({all_}, i -> struct(own * parts + i as salt, true as home)), array()), transform({all_}, i -> struct(i * parts + own as salt, false as home)))"
        dealt = dealt.select("anchor", "fp", F.explode(F.expr(own.format(cells))).alias("cell")).select("anchor", "fp", "cell.salt", "cell.home")
    dealt = dealt.select("anchor", "salt", "home", "fp").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "fp")
    return dealt.mapInArrow(_compare(threshold), "a long, b long").distinct()


def _classes(docs: DataFrame, threshold: int) -> DataFrame:
    """``doc_id, hash`` (of the text), ``fp, component_id, root`` (a fingerprint, the same in all of a
    component) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(_fingerprints, f"doc_id {kind}, hash long, fp long")
    own = materialize(own, "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    size = first.agg(F.count("*").alias("fps"), F.sum("n").alias("docs")).first()
    layout = THREE if size.fps <= MANY else TWO
    roots = materialize(connected_components(near_links(first.select("fp"), threshold, layout)), "roots")
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "first")
    classes = materialize(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("members")), "classes")
    linked = joined_by_key(linked, classes, "root", "members", size.fps).select(F.col("node").alias("fp"), "root", "least")
    of = first.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return joined_by_key(own, materialize(of, "of"), "fp", "n", size.docs or 0)


def near_duplicates(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """Per document ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest
    doc_id that links of ``threshold`` or fewer differing bits reach, itself included.

    Copies meet in one fingerprint first, so that only distinct fingerprints are spread. A null
    text has no words: fingerprint zero, linked like any other. A null doc_id keeps its row and
    is never the smallest; a component of null ids alone has a null id. Repeated rows give
    repeated results; an empty table none; other columns are not read.
    """
    return _classes(docs, threshold).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """``docs`` without all but one document, of the smallest doc_id, of each component. Rows with a
    null doc_id stay, as nothing tells them apart; rows that repeat an id and a text become one,
    and of different texts of that one id in a component the one whose hash is lowest stays. All
    columns stay, whatever their names; an empty table gives no rows."""
    found = _classes(docs, threshold)
    stay = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "root").agg(F.min("hash").alias("hash")).select("doc_id", "hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    known = rows.where("doc_id is not null").join(stay, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    return known.select("row.*").unionByName(docs.where("doc_id is null"))
