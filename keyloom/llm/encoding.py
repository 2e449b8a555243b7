"""Fast, exact batch encoding with a public tokenizer file.

Texts of Latin letters and ASCII go through the same merges in a faster engine; all others,
and those with special strings, go to the tokenizer's library, long ones in segments. A
segment ends at a single space whose neighbours are ASCII or Latin characters: both supported
kinds of vocabulary end a token there, whatever stands around.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _safe(char: str) -> bool:
    return "!" <= char <= "~" or "À" <= char <= "ɏ"


def segments(text: str, limit: int) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces of at least ``limit`` characters that end before a safe space, with
    True for the first; the space itself is left out. One piece if there is no such space."""
    at, first = 0, True
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and not (cut + 1 < len(text) and _safe(text[cut - 1]) and _safe(text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut], first
        at, first = cut + 1, False
    yield text[at:], first


# --- merges in a faster engine -------------------------------------------------------------

#: Fixed value: how byte-level BPE splits a text.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = "</w>"
#: Stands for the end of a word among bytes; no text that is encoded here holds it.
MARK = "\x80"
#: What is left to the library: characters beyond Latin, the mark, the capital whose small form is two characters, and special strings.
_OTHER = re.compile("[^\0-\x7f\x81-ſ]|İ|<\\|")
#: Fixed value: how the lower-case vocabulary splits a text into words, for Latin characters.
_PIECES = re.compile("'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ſ0-9²³¹¼½¾]+")

#: The same, with the line ends that stand between words.
_PIECES_AND_BREAKS = re.compile(_PIECES.pattern + "|\n")


def _letters() -> dict[str, int]:
    """The character by which a vocabulary file writes each byte: itself if printable, else the
    next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _merged_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to id + 1, MARK to 0; None unless ids follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], _letters()
    ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if ids != sorted(ids):
        return None
    ranks = {MARK.encode(): 0}
    for token, i in vocab.items():
        body, end = (token.removesuffix(WORD_END), MARK.encode()) if token.endswith(WORD_END) else (token, b"")
        if all(c in letters for c in body):
            ranks.setdefault(bytes(letters[c] for c in body) + end, i + 1)
    return ranks


class TextEncoder:
    """Encodes whole texts as ``tokenizers`` does without added tokens.

    keeps_space: whether the vocabulary has tokens that begin with a space (byte-level BPE);
    otherwise white space only separates words, and the vocabulary has no capitals. segment:
    characters from which on a text is encoded in parts.
    """

    def __init__(self, path: str, keeps_space: bool, segment: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keeps_space, self.segment, self.engine = keeps_space, segment, None
        ranks = _merged_ranks(path)
        self.line_end = (ranks or {}).get(("\n" + MARK).encode())
        if ranks is not None:
            pattern = BYTE_PATTERN if keeps_space else f"[^{MARK}]+{MARK}"
            self.engine = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, text: str) -> bytes:
        if self.engine is None or _OTHER.search(text):
            return self._library(text)
        if not self.keeps_space:
            pieces = _PIECES.findall(text.lower())
            if not pieces:
                return b""
            pieces.append("")
            text = MARK.join(pieces)
        return (self.engine.encode_to_numpy(text) - np.uint32(1)).astype(self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as bytes of ``self.dtype``."""
        if len(text) <= self.segment:
            return self._encode(text) if text else b""
        lead = " " if self.keeps_space else ""
        return b"".join(self._encode(piece if first else lead + piece) for piece, first in segments(text, self.segment))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words or stretches of words, without line ends, for a vocabulary without spaces."""
        if self.engine is None or self.line_end is None:
            return self.encode_batch(words)
        text = "\n".join(words)
        if _OTHER.search(text):
            plain = iter(self.encode_words([w for w in words if not _OTHER.search(w)]))
            return [self._library(w) if _OTHER.search(w) else next(plain) for w in words]
        ids = self.engine.encode_to_numpy(MARK.join(_PIECES_AND_BREAKS.findall(text.lower())) + MARK)
        ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        size = self.dtype.itemsize
        raw, ends = (ids - np.uint32(1)).astype(self.dtype).tobytes(), (ends * size).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + size for e in ends[:-1])], ends, strict=True)] if words else []

    def encode_word_array(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of words without line ends, one after the other, and how many each has."""
        if len(words) and self.engine is not None and self.line_end is not None:
            whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            text = pc.binary_join(whole, "\n")[0].as_py()
            if not _OTHER.search(text):
                ids = self.engine.encode_to_numpy(MARK.join(_PIECES_AND_BREAKS.findall(text.lower())) + MARK)
                breaks = ids == self.line_end
                ends = np.append(np.flatnonzero(breaks), len(ids))
                return (ids[~breaks] - np.uint32(1)).astype(self.dtype), np.diff(ends, prepend=-1) - 1
        coded = self.encode_words(words.to_pylist())
        return np.frombuffer(b"".join(coded), self.dtype), np.array([len(x) for x in coded], np.int64) // self.dtype.itemsize

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, keeps_space: bool) -> TextEncoder:
    """One encoder for each worker process, tokenizer and kind."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = TextEncoder(path, keeps_space)
    return _encoders[path, keeps_space]
