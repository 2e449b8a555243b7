"""Operator 3: token counts of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import texts_by_bytes
from .encoding import encoder


def _counter(path: str, keeps_space: bool, limit: int, batch_bytes: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space)
        for batch in batches:
            texts, n = batch.column("text"), []
            for a, b in texts_by_bytes(batch, "text", batch_bytes):
                n += [len(x) // enc.dtype.itemsize for x in enc.encode_batch([t or "" for t in texts.slice(a, b - a).to_pylist()])]
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            n_tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, keeps_space: bool = False, limit: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``, in one narrow Arrow stage.

    Only lengths leave Python. Batches hold about ``batch_bytes`` of text, whatever the
    number of rows; a text that is longer is encoded in segments cut at safe spaces. A null
    text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows give
    repeated results; other columns of ``docs`` are never read. ``tokenizer`` is the path of a
    tokenizer file which every executor has.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(_counter(tokenizer, keeps_space, limit, batch_bytes), schema)
