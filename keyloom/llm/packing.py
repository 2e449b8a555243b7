"""Operator 4: packing token sequences with Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_by_bytes
from .encoding import encoder


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by largest differencing.

    Each size starts as a partial partition into k windows of which one is filled. The two
    partitions with the largest imbalance are merged, heaviest window on lightest, until one
    is left. Most merges add a single size, which moves one window only.
    """
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    parent = list(range(n))
    # (minus the imbalance, serial, minus the load of each window in ascending order, a size in each
    # window or -1); a single size has no windows yet and its index as serial.
    heap: list[tuple] = [(-size, i, None, None) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1 or heap[0][2] is None:
        first = heapq.heappop(heap)
        if first[2] is None and (not heap or heap[0][2] is None):
            loads, owner = [first[0]] + [0] * (k - 1), [first[1]] + [-1] * (k - 1)
        else:
            loads, owner = first[2:]
        if heap:
            second = heapq.heappop(heap)
            if loads is None:
                (loads, owner), second = second[2:], first
            if second[2] is None:
                load, mine, i = loads.pop() + second[0], owner.pop(), second[1]
                if mine >= 0:
                    parent[i], i = mine, mine
                at = bisect_right(loads, load)
                loads.insert(at, load)
                owner.insert(at, i)
            else:
                both = []
                for a, b, i, j in zip(loads, reversed(second[2]), owner, reversed(second[3]), strict=True):
                    if i >= 0 and j >= 0:
                        parent[j] = i
                    both.append((a + b, i if i >= 0 else j))
                both.sort(key=lambda x: x[0])
                loads, owner = [x[0] for x in both], [x[1] for x in both]
        heapq.heappush(heap, (loads[0] - loads[-1], serial, loads, owner))
        serial += 1
    group = np.array(heap[0][3])
    window = np.full(n, -1, np.int64)
    window[group[group >= 0]] = np.flatnonzero(group >= 0)
    root = np.array(parent)
    while not np.array_equal(again := root[root], root):
        root = again
    return window[root]


def balanced_windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Near-equal windows of at most ``capacity``; their number rises until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = karmarkar_karp(sizes, k)
        if np.bincount(window, sizes, k).max(initial=0) <= capacity:
            return window, k
        k += 1


def cuts(n: int, capacity: int, fillers: int) -> list[tuple[int, int]]:
    """(start, length) pieces of a document of n tokens: whole windows, then the rest, halved
    ``fillers`` times so that small pieces can even out the large ones."""
    out = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at = n - n % capacity
    for _ in range(fillers):
        half = (n - at + 1) // 2
        if half < 16:
            break
        out.append((at, half))
        at += half
    return [*out, (at, n - at)] if n > at else out


def _packer(path: str, keeps_space: bool, capacity: int, end_id: int, bucket: int, fillers: int, doc_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, serial = encoder(path, keeps_space), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        whole: list[tuple] = []
        open_: list[tuple] = []
        held = 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def flush() -> pa.RecordBatch:
            nonlocal serial
            window, k = balanced_windows(np.array([r[2] for r in open_], np.int64), capacity)
            fill, rows = [0] * k, []
            for r, w in zip(open_, window.tolist(), strict=True):
                rows.append((*r, serial + w, fill[w]))
                fill[w] += r[2]
            serial += k
            return table(rows)

        for batch in batches:
            ids_of, docs = batch.column("text"), batch.column("doc_id")
            for a, b in texts_by_bytes(batch, "text"):
                texts = [t or "" for t in ids_of.slice(a, b - a).to_pylist()]
                for doc, raw in zip(docs.slice(a, b - a).to_pylist(), enc.encode_batch(texts), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, enc.dtype).astype("<u4"), end])
                    for start, length in cuts(len(ids), capacity, fillers):
                        row = (doc, start, length, ids[start : start + length].tobytes(), len(ids))
                        if length == capacity:
                            whole.append((*row, serial, 0))
                            serial += 1
                            if len(whole) >= 8 * bucket:
                                yield table(whole)
                                whole = []
                        else:
                            open_.append(row)
                            held += length
                            if held >= bucket * capacity:
                                yield flush()
                                open_, held = [], 0
                if whole:
                    yield table(whole)
                    whole = []
        if open_:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, keeps_space: bool = False, capacity: int = 2048, end_id: int = 1, bucket: int = 128, fillers: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens, one row per piece:
    ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``. Whole windows of a long document stand alone; the
    rests of a partition are gathered until they fill about ``bucket`` windows, which
    Karmarkar-Karp differencing then makes near-equal, and the window count rises while one
    is over capacity. No shuffle, and one bucket in memory at a time, so hot keys or copies do
    not matter; a retried task gives the same rows. Sequence ids are unique but not gapless.
    A null or empty text is the end token alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, keeps_space, capacity, end_id, bucket, fillers, to_arrow_type(kind)), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of whole sequences, for writing them out."""
    from pyspark.sql import functions as F

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
