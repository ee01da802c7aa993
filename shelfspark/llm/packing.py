"""Packing of tokenised documents into fixed-length sequences: shortest pack first over the length histogram.

A document is cut into full pieces of the sequence length and a remainder. Only the histogram of
remainder lengths (one count for each length) comes to the driver. Lengths are placed longest first:
each piece goes into the shortest open pack, the one with the most room, and opens a new one if it
does not fit there. Equal packs are one pattern with a count and are filled together, so the work
depends on the number of distinct patterns and not of documents.
The patterns then become slots (length, ranks from-to, first sequence, offset), and a piece finds its
sequence by its rank among the pieces of its length. Ranks are counted within salted parts of each
length, as many as its pieces need, so a length that most documents share is spread over many tasks.
"""

from __future__ import annotations

import base64
import zlib
from bisect import insort
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .core import arrow_limits, documents, stash

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 1024
#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 100_000
#: Rows of slots that may be broadcast; each has five numbers.
BROADCAST_SLOTS = 200_000
CACHE_WORDS = 250_000
_UNSETTLED = regex.compile("[̀-\U0010ffff]")


class ByteTokens:
    """Token ids as the tokenizers library gives them, found once for each distinct piece of a text.

    The library's splitter cuts a text by a fixed pattern and encodes each piece by itself. Below
    U+0300 the pattern gives the same pieces here, and the same vocabulary's ranks give a piece's ids;
    texts beyond, or with special tokens, go to the library whole.
    """

    def __init__(self, name: str = VOCABULARY):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if _UNSETTLED.search(t) or any(s in t for s in self.special) else self.find(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in {w for words in split if words for w in words if w not in self.cache}:
            ids = self.piece(w)
            self.cache[w] = packed(f"<{len(ids)}I", *ids)
        get = self.cache.__getitem__
        return [self._whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]


_tokens: dict[str, ByteTokens] = {}


def byte_tokens(name: str = VOCABULARY) -> ByteTokens:
    if name not in _tokens:
        _tokens[name] = ByteTokens(name)
    return _tokens[name]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Each document's ids, ended by id 0, as pieces of at most ``length`` ids (``ids`` holds them if asked for)."""
    arrow_limits(df.sparkSession)
    end = np.array([0], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, raw in zip(b.column(0).to_pylist(), tokens.ids(texts), strict=True):
                raw += end
                for at in range(0, len(raw), 4 * length):
                    own = raw[at : at + 4 * length]
                    rows.append((doc, at // 4, len(own) // 4, zlib.crc32(own), len(raw) // 4, own))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            made = [pa.array(c, pa.int64()) for c in columns[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                made.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names=names)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_histogram(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one pack, in order) and how many packs have each, from counts of lengths below ``room``.

    Each length goes, longest first, into the open pack with the most room, of equal ones into that with the least
    pattern; if it does not fit there it fits nowhere and opens a pack.
    """
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> {pattern: count}
    rooms: list[int] = []  # the sorted keys of groups

    def put(pattern: tuple[int, ...], count: int, left: int) -> None:
        if left not in groups:
            groups[left] = {}
            insort(rooms, left)
        groups[left][pattern] = groups[left].get(pattern, 0) + count

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        todo = histogram[length]
        while todo and rooms and rooms[-1] >= length:
            left = rooms.pop()  # of all these packs none gets this length twice before each has it once
            for pattern, count in sorted(groups.pop(left).items()):
                used = min(count, todo)
                todo -= used
                if used:
                    put(pattern + (length,), used, left - length)
                if count > used:
                    put(pattern, count - used, left)
        each = room // length  # a new pack has the most room until it is full
        full, rest = divmod(todo, each)
        for count, n in ((each, full), (rest, 1)):
            if count and n:
                put((length,) * count, n, room - count * length)
    return [(p, c) for left in sorted(groups) for p, c in sorted(groups[left].items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last rank, first sequence, offset), sequences counted from 0."""
    out, taken, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return out


def _ranked(parts: DataFrame, histogram: dict[int, int], length: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length, by salt and then by document."""
    salts = F.array(*(F.lit(1 + histogram.get(k, 0) // RANKED_TOGETHER) for k in range(length + 1)))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = salted.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at")).drop("salt", "at", "before")


def pack(parts: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``; every piece lies in exactly one sequence, gapless from 0.

    Full pieces are sequences of their own. No pieces give no rows; repeated rows are packed each.
    """
    spark = parts.sparkSession
    parts = stash(parts, "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``length`` rows at most
    full = histogram.get(length, 0)
    table = slots(pack_histogram({k: n for k, n in histogram.items() if k < length}, length))
    if full:
        first = max((s + hi - lo for _, lo, hi, s, _ in table), default=0)
        table.append((length, 0, full, first, 0))
    placed = spark.createDataFrame(table, "p_length long, lo long, hi long, first long, offset long")
    placed = F.broadcast(placed) if len(table) <= BROADCAST_SLOTS else placed
    found = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ranked = _ranked(parts, histogram, length)
    return ranked.join(placed, found).select(*parts.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document, with its sequence and its offset there."""
    return pack(pieces(documents(spark, sf_dir)))
