"""TIFF columns: payloads stored as 8-bit images and read back, one row per page.

``write_tiff`` stores arrays of 8-bit samples, one image directory for each page, in strips or tiles,
uncompressed or with PackBits, LZW or deflate, with or without the horizontal predictor.
``read_tiff`` walks the directories of either byte order, decodes the blocks and undoes the predictor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_limits, documents

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
CLEAR, END = 256, 257

ROW = 64
PAGE_ROWS = 1024


def packbits_encode(data: bytes) -> bytes:
    out, n, i, literal = bytearray(), len(data), 0, 0
    a = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)

    def flush(end: int) -> None:
        nonlocal literal
        while literal < end:
            k = min(128, end - literal)
            out.append(k - 1)
            out.extend(data[literal : literal + k])
            literal += k

    long = np.flatnonzero(np.diff(edges) >= 3)
    for start, end in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
        flush(start)
        i = start
        while end - i >= 2:
            k = min(128, end - i)
            out += bytes(((257 - k) & 0xFF, data[i]))
            i += k
        literal = i
    flush(n)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 1 if k == 128 else 2
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    bits, held, width, out, after = 0, 0, 9, bytearray(), 258

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            out.append(held >> (bits - 8) & 0xFF)
            bits -= 8
        held &= (1 << bits) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = after
        after += 1
        if after == 4094:
            put(CLEAR)
            table, after, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = max(9, after.bit_length())  # a reader is one entry behind
        word = data[i : i + 1]
    if word:
        put(table[word])
        width = max(9, (after + 1).bit_length())
    put(END)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out = list(first), 9, bytearray()
    held = bits = at = 0
    before = b""
    while True:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held = (held << 8 | data[at]) & 0xFFFFFFFF
            bits += 8
            at += 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == END:
            return bytes(out)
        if code == CLEAR:
            table, width, before = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise ValueError("a code is not in the LZW table")
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        width = min(12, max(9, (len(table) + 1).bit_length()))


_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 2), PACKBITS: packbits_encode}


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


_DECODE = {NONE: lambda b, most: bytes(b), LZW: lambda b, most: lzw_decode(b), DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: lambda b, most: packbits_decode(b)}
#: Bytes of samples that a page may have.
MAX_PAGE = 1 << 30


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: bool = True, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages are arrays (height, width) or (height, width, samples) of uint8; strips of ``rows`` rows, or tiles (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        image = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, sizes = [], []
        for b in blocks:
            if predictor:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = _ENCODE[compression](b.tobytes())
            out += b"\0" * (len(out) & 1)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1])]
        if predictor:
            tags.append((PREDICTOR, 3, [2]))
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            letter, size = _TYPES[kind]
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a file, by walking its chain of image directories; 8-bit samples, contiguous planes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _TYPES:
                letter, size = _TYPES[kind]
                where = at + 10 + 12 * k
                if size * count > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
        compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or compression not in _DECODE:
            raise ValueError("only contiguous 8-bit samples in a known compression are read")
        tiled = TILE_OFFSETS in tags
        bh, bw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
        if min(width, height, samples, bh, bw) < 1 or width * height * samples > MAX_PAGE or bh * bw * samples > MAX_PAGE:
            raise ValueError("a page has no samples or too many")
        across = -(-width // bw)
        offsets, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]
        if len(offsets) != len(sizes) or len(offsets) != -(-height // bh) * across:
            raise ValueError("strips or tiles are missing")
        pixels = np.empty((height, width, samples), np.uint8)
        for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = k // across * bh, k % across * bw
            rows = bh if tiled else min(bh, height - y)
            block = np.frombuffer(_DECODE[compression](data[start : start + size], rows * bw * samples), np.uint8)[: rows * bw * samples].reshape(rows, bw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            pixels[y : y + rows, x : x + bw] = block[: height - y, : width - x]
        yield Page(number, width, height, samples, compression, predictor, tiled, pixels)
        number += 1
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


PAGES = "doc_id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
#: What a broken file may raise on its way.
BROKEN = (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError)


def read_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each page of each file. A null file has no pages; a broken one has its readable pages and a row that has only ``error``."""
    arrow_limits(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("page", "width", "height", "samples", "compression", "predictor")), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for p in read_tiff(media) if media is not None else ():
                        own = {"doc_id": doc, "page": p.number, "width": p.width, "height": p.height, "samples": p.samples, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "pixels": p.pixels.tobytes(), "error": None}
                        yield pa.RecordBatch.from_pylist([own], schema)
                except BROKEN as e:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}], schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col)).mapInArrow(run, PAGES)


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with bytes 0 to a positive multiple of 64, and their number without those."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


#: The forms in which payloads are stored, chosen by their checksum: compression, predictor, tile.
FORMS = [(PACKBITS, True, None), (LZW, True, (64, 64)), (PACKBITS, False, (32, 64)), (DEFLATE, False, (128, 64)), *[(DEFLATE, True, None)] * 12]


def store(data: bytes) -> bytes:
    """A payload as pages of rows of 64 samples, in one of FORMS; equal payloads have equal files."""
    image = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    compression, predictor, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF file, reads its pages back and describes what was read; a null text is empty.

    ``feature``: pages, rows, mean and largest sample, and the entropy in bits of the samples.
    """
    arrow_limits(df.sparkSession)

    def row(text: str | None) -> tuple:
        data, n = payload(text)
        media = store(data)
        pages = list(read_tiff(media))
        back = b"".join(p.pixels.tobytes() for p in pages)
        counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
        share = counts[counts > 0] / len(back)
        mean = float(counts @ np.arange(256)) / len(back)
        feature = f"pages={len(pages)};rows={sum(p.height for p in pages)};mean={mean:.4f};max={np.flatnonzero(counts)[-1]};entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], names=["doc_id", *kinds])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the digests of its text stored as TIFF pages and read back, and features of the samples."""
    return media_features(documents(spark, sf_dir))
