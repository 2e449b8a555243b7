"""Operator 1: TIFF media columns."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import texts_by_bytes

# Fixed values of the format: tags, field types and their sizes, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END, TABLE_FULL = 256, 257, 4094


class TiffError(ValueError):
    """The bytes are no TIFF image that this module reads."""


# --- compression ---------------------------------------------------------------------------


def packbits_encode(data: bytes, row: int) -> bytes:
    """Each row by itself: runs of three and more as a count and a byte, the rest as literals."""
    out = bytearray()

    def literal(part: bytes) -> None:
        for at in range(0, len(part), 128):
            some = part[at : at + 128]
            out.append(len(some) - 1)
            out.extend(some)

    for at in range(0, len(data), row):
        line, done = data[at : at + row], 0
        for m in re.finditer(rb"(.)\1{2,127}", line, re.S):
            literal(line[done : m.start()])
            out.append(257 - len(m[0]))
            out += m[1]
            done = m.end()
        literal(line[done:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, held = [], 0, 0
    while held < size and at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
            held += n + 1
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            held += 257 - n
        else:
            at += 1
    return b"".join(out)[:size]


@cache
def _widths() -> np.ndarray:
    """Bits of the k-th code after a clear code: the table has grown by k entries from 258 on, and
    a width ends one entry early."""
    k = np.arange(4096)
    return 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    schedule = _widths().tolist()
    table: dict[int, int] = {}
    free, k, prefix = 258, 0, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        widths.append(schedule[k])
        k += 1
        table[key] = free
        prefix = byte
        if free == TABLE_FULL:
            codes.append(CLEAR)
            widths.append(12)
            table, free, k = {}, 258, 0
        else:
            free += 1
    if prefix >= 0:
        codes.append(prefix)
        widths.append(schedule[k])
        k += 1
    codes.append(END)
    widths.append(schedule[k])
    c, w = np.array(codes, np.int64)[:, None], np.array(widths)[:, None]
    place = np.arange(16)
    bits = (c >> (15 - place)) & 1
    return np.packbits(bits[place >= 16 - w].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, width = 8 * len(data), 0, 9
    offsets = np.concatenate([[0], np.cumsum(_widths())])
    out: list[bytes] = []
    held = 0

    def code(bit: int, n: int) -> int:
        byte = bit >> 3
        return int((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - n - (bit & 7))) & ((1 << n) - 1)

    while held < size and at + width <= total:
        first = code(at, width)
        at += width
        if first == END:
            break
        if first != CLEAR:
            raise TiffError("LZW data do not begin with a clear code")
        spans = offsets[:-1][at + offsets[1:] <= total]
        n, bit = _widths()[: len(spans)], at + spans
        byte = bit >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = (window >> (24 - n - (bit & 7))) & ((1 << n) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        used = int(stop[0]) if len(stop) else len(codes)
        if used:
            table = _bytes_table().copy()
            todo = codes[:used].tolist()
            if todo[0] > 255:
                raise TiffError("LZW data are damaged")
            last = table[todo[0]]
            out.append(last)
            for c in todo[1:]:
                if c < len(table):
                    entry = table[c]
                elif c == len(table):
                    entry = last + last[:1]
                else:
                    raise TiffError("LZW data are damaged")
                table.append(last + entry[:1])
                out.append(entry)
                last = entry
            held += sum(map(len, out[-used:]))
        if not len(stop):
            break
        at += int(offsets[used])
        width = int(_widths()[used])
    return b"".join(out)[:size]


@cache
def _bytes_table() -> list[bytes]:
    return [bytes([i]) for i in range(256)] + [b"", b""]


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {compression} is not read")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out


# --- reading -------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise TiffError("the chain of directories is a loop")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            tags: dict[int, tuple] = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in TYPES:
                    form = f"{order}{count}{TYPES[kind]}"
                    size, place = struct.calcsize(form), at + 10 + 12 * i
                    tags[tag] = struct.unpack_from(form, data, place if size <= 4 else struct.unpack_from(order + "I", data, place)[0])
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            raise TiffError("a directory is cut short") from e
        yield order, tags


def _unpredict(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: (rows, columns, samples)."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        planes = np.cumsum(np.frombuffer(block.tobytes(), np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, block.itemsize, columns * samples).transpose(0, 2, 1)
        return np.frombuffer(planes.tobytes(), f">f{block.itemsize}").reshape(block.shape)
    raise TiffError(f"predictor {predictor} is not read")


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> dict:
    """Size and samples of one page; samples little-endian, row by row, channels together."""

    def one(tag: int, default: int | None = None) -> int:
        if tag not in tags:
            if default is None:
                raise TiffError(f"tag {tag} is missing")
            return default
        return tags[tag][0]

    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits = set(tags.get(BITS, (1,)))
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if len(bits) != 1 or kind is None or next(iter(bits)) not in ((8, 16, 32) if kind != "f" else (16, 32, 64)):
        raise TiffError(f"samples of {sorted(bits)} bits are not read")
    depth = next(iter(bits))
    planes = samples if one(PLANAR, 1) == 2 else 1
    per = samples // planes
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
    else:
        across, down, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    # No compression that is read here packs more than some 2,600 bytes into one.
    if not (width and height and across and down) or width * height * samples * depth // 8 > min(1 << 31, len(data) << 12):
        raise TiffError("the page has no usable size")
    columns, lines = -(-width // across), -(-height // down)
    if len(offsets) < columns * lines * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    dtype = np.dtype(f"{order}{kind}{depth // 8}")
    page = np.zeros((height, width, samples), dtype.newbyteorder("<"))
    for i in range(columns * lines * planes):
        plane, place = divmod(i, columns * lines)
        y, x = place // columns * down, place % columns * across
        rows = down if tiled else min(down, height - y)
        raw = _unpack(data[offsets[i] : offsets[i] + counts[i]], compression, rows * across * per * dtype.itemsize)
        block = _unpredict(np.frombuffer(raw, dtype).reshape(rows, across, per), predictor, order)
        page[y : y + down, x : x + across, plane * per : (plane + 1) * per] = block[: height - y, : width - x]
    return {"width": width, "height": height, "samples": samples, "bits": depth, "compression": compression, "predictor": predictor, "tiled": tiled, "mean": float(page.mean()), "pixels": page.tobytes()}


def read_pages(data: bytes | None) -> tuple[list[dict], str | None]:
    """All pages up to the first error, and that error."""
    pages: list[dict] = []
    try:
        if data is None:
            raise TiffError("no data")
        for order, tags in directories(bytes(data)):
            pages.append({"page": len(pages), **read_page(bytes(data), order, tags)})
    except (TiffError, zlib.error, ValueError, MemoryError) as e:
        return pages, str(e) or type(e).__name__
    return pages, None


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, mean double, pixels binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("mean", pa.float64()), ("pixels", pa.binary())])
    for batch in batches:
        for a, b in texts_by_bytes(batch, "media", 2 << 20):
            part = batch.slice(a, b - a)
            found = [read_pages(x) for x in part.column("media").to_pylist()]
            pages, errors = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("keys"), pa.array(pages, pa.list_(page)), pa.array(errors, pa.string())], ["keys", "pages", "error"])


def _decoded(df: DataFrame, media: str, keys: list[str]) -> DataFrame:
    """``keys`` (a struct), ``pages`` and ``error``."""
    own = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("keys"), F.col(f"`{media}`").alias("media"))
    made = StructType.fromDDL(f"pages array<struct<{', '.join(x.replace(' ', ': ', 1) for x in PAGE.split(', '))}>>, error string")
    return own.mapInArrow(_decode, StructType([*own.select("keys").schema, *made]))


def _apart(keys: list[str], made: set[str]) -> None:
    """Keys must not have the names of columns that are made."""
    same = sorted(k for k in keys if k.lower() in made)
    if same:
        raise ValueError(f"rename the columns {same}: decoding makes columns of these names")


def decode_documents(df: DataFrame, media: str, keys: list[str]) -> DataFrame:
    """``keys``, ``pages`` (an array of page structs) and ``error`` per row, in one narrow stage.
    A null or damaged medium has the pages before the damage and an error text; a null key stays
    null, repeated rows repeat, an empty table gives none. Keys named ``pages`` or ``error`` are an
    error; other columns are not read."""
    _apart(keys, {"pages", "error"})
    return _decoded(df, media, keys).select("keys.*", "pages", "error")


def decode_pages(df: DataFrame, media: str, keys: list[str]) -> DataFrame:
    """One row per page: ``keys`` and the columns of ``PAGE``, of which no key may have the name; a
    medium without pages gives none. Otherwise as ``decode_documents``."""
    _apart(keys, {x.split()[0] for x in PAGE.split(", ")})
    return _decoded(df, media, keys).select("keys", F.explode("pages").alias("of")).select("keys.*", "of.*")


# --- writing -------------------------------------------------------------------------------


def write_tiff(payload: bytes, width: int = 64, page_rows: int = 512, compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 128) -> bytes:
    """A little-endian TIFF of 8-bit grey pages with ``payload``, a multiple of ``width``, as samples."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        if tile:
            down, across = tile
            whole = np.zeros((-(-len(page) // down) * down, -(-width // across) * across), np.uint8)
            whole[: len(page), :width] = page
            blocks = [whole[y : y + down, x : x + across] for y in range(0, len(whole), down) for x in range(0, whole.shape[1], across)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            raw = np.ascontiguousarray(block).tobytes()
            if compression == LZW:
                raw = lzw_encode(raw)
            elif compression == PACKBITS:
                raw = packbits_encode(raw, block.shape[1])
            elif compression != NONE:
                raw = zlib.compress(raw, 1)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw
            out += b"\0" * (len(out) % 2)
        tags = {WIDTH: (4, [width]), LENGTH: (4, [len(page)]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_LENGTH: (4, [tile[0]]), TILE_OFFSETS: (4, places), TILE_COUNTS: (4, sizes)}
        else:
            tags |= {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_COUNTS: (4, sizes)}
        entries = bytearray(struct.pack("<H", len(tags)))
        for tag, (kind, values) in sorted(tags.items()):
            value = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(value) > 4:
                place = len(out)
                out += value
                value = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(entries)
        out += entries + b"\0\0\0\0"
    return bytes(out)


#: (compression, predictor) of stored documents, by their checksum.
_STORED = ((ADOBE_DEFLATE, 1), (PACKBITS, 1), (ADOBE_DEFLATE, 2), (LZW, 1))


def store_text(text: str | None, unit: int = 64) -> bytes:
    """The text as UTF-8, with bytes 0 up to a positive multiple of ``unit``, as a TIFF image. Scheme,
    predictor and layout follow from the payload, so equal texts give equal bytes."""
    raw = (text or "").encode()
    payload = raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")
    crc = zlib.crc32(payload)
    compression, predictor = _STORED[crc & 3]
    return write_tiff(payload, unit, compression=compression, predictor=predictor, tile=(128, 32) if crc & 4 else None)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in texts_by_bytes(batch, "text", 2 << 20):
            part = batch.slice(a, b - a)
            media = [store_text(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def stored_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text (null: empty) as a TIFF file. Null ids stay null,
    repeated rows repeat, an empty table gives no rows, other columns are not read."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")
