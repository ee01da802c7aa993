"""Repeated passages: level-wise doubling, and sparse suffix arrays at minimiser positions.

Both find every window of a given number of words whose word sequence occurs at least twice in the
corpus, by exchanging 64-bit window hashes (see ``core``); neither compares documents in pairs.

*Level-wise doubling* begins with the windows of a quarter of the length. Those that repeat are
extended to twice the length where both halves repeat, and again, until the full length. The first
levels compare 32 bits beside the bucket, which can only let too many windows through; the last level
compares 64 bits.

*Sparse suffix arrays* retain the suffixes that start at minimisers: the leftmost smallest hash of
``SEED`` words among the ``min_words - SEED + 1`` that a passage of ``min_words`` contains, so equal
passages retain a suffix at the same place. Suffixes whose first ``SEED`` words occur once are dropped. The
others are dealt by those words, with as many words to the left and right as a passage can have, sorted, and
neighbours compared. Neighbours with at least r words in common to the right form intervals of the sorted
order; within one, equal words to the left extend the match to a passage that lies l words before the suffix,
l + r = ``min_words``. So a match to the left is found although the neighbour in sorted order has another one.
Words are compared by 32 bits of their hashes, a passage by all of its words. First words that very many
suffixes share are dealt by more words, to the right for passages that lie there and to the left for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import FIRST, KEYS, Chunk, Words, bucket_bits, chunk_corpus, discard, documents, from_chunks, keys_out, member, mix64, over_chunks, prefix_for, repeated_keys, reply_keys, shorten, small, stash, total_words, trim, window_hashes, written

WINDOW = 35
MIN_WORDS = 50
SEED = 16
#: Suffixes with the same first words above which they are dealt by more words.
HOT = 20_000
BROADCAST_ROWS = 200_000


def _distinct(chunk: Chunk, keys: np.ndarray, bits: int, wide: bool) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(shorten(keys, bits, wide), return_counts=True)
    if len(keys):
        yield keys_out(chunk.chunk, keys, counts, bits, wide)


def covered(n_words: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window of ``length`` that starts at one of ``at``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:n_words] > 0


# --- level-wise doubling ---------------------------------------------------------------------


def window_levels(window: int) -> list[int]:
    """Lengths of the levels: a quarter, a half and all of the window, rounded up."""
    return sorted({max(1, -(-window // 4)), max(1, -(-window // 2)), window})


def repeated_windows(chunks: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The repeated windows of the last level, as replies to the chunks, and the number of bucket bits."""
    bits = bucket_bits(total_words(chunks))
    levels = window_levels(window)

    def first(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        words = chunk.words()
        yield from _distinct(chunk, window_hashes(words.hashes(), words.windows(levels[0]), levels[0]), bits, len(levels) == 1)

    reply = stash(repeated_keys(from_chunks(chunks, first, KEYS), len(levels) == 1), "level", large=True)
    for before, length in zip(levels, levels[1:], strict=False):
        wide = length == window

        def extend(chunk: Chunk, table: pa.Table, before=before, length=length, wide=wide) -> Iterator[pa.RecordBatch]:
            repeated, _ = reply_keys(table, bits, False)
            words = chunk.words()
            hashes = words.hashes()
            at = words.windows(before)
            alone = np.zeros(len(words), bool)
            alone[at] = member(shorten(window_hashes(hashes, at, before), bits, False), repeated)
            longer = words.windows(length)
            longer = longer[alone[longer] & alone[longer + length - before]]
            yield from _distinct(chunk, window_hashes(hashes, longer, length), bits, wide)

        mark = written() - 1  # the level before
        reply = stash(repeated_keys(over_chunks(chunks, reply, extend, KEYS), wide), "level", large=True)
        discard(chunks.sparkSession, mark, reply)
    return reply, bits


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of words that also starts anywhere else, all occurrences alike.

    One row for each document: numbers of words and of removed ones, and the digest of the kept words
    joined by one space (``kept`` has them, if asked for). A null or empty text has no words; repeated
    rows are documents of their own, so each is the other's repetition.
    """
    chunks = chunk_corpus(docs, id_col, text_col)
    reply, bits = repeated_windows(chunks, window)

    def finish(chunk: Chunk, table: pa.Table) -> Iterator[pa.RecordBatch]:
        repeated, _ = reply_keys(table, bits, True)
        words = chunk.words()
        gone = np.zeros(len(words), bool)
        if len(repeated):
            at = words.windows(window)
            gone = covered(len(words), at[member(window_hashes(words.hashes(), at, window), repeated)], window)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        raw, kept = words.data.tobytes(), []
        for d in range(len(chunk.ids)):
            parts = raw[words.offsets[d] : words.offsets[d + 1]].split()
            if removed[d]:
                parts = [p for p, g in zip(parts, gone[words.first[d] : words.first[d + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(parts))
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return over_chunks(chunks, reply, finish, REMOVED + (", kept string" if with_text else ""))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many words it has, how many lie in a window of 35 that starts elsewhere too, and the digest of the others. Null and empty texts have no words; repeated rows repeat each other."""
    return remove_repeats(documents(spark, sf_dir))


# --- sparse suffix arrays --------------------------------------------------------------------


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the index of the least one, the leftmost of equal ones, by doubling."""
    out, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = out[:-step], out[step:]
        out = np.where(values[b] < values[a], b, a)
        have += step
    return out


class Suffixes:
    """The suffixes retained in a run of documents: ``places`` are their first words, ``heads`` the hashes of their first ``seed`` words.

    ``own[i, l]``: a passage of ``length`` words that starts l words before ``places[i]`` has its minimiser there.
    """

    def __init__(self, words: Words, hashes: np.ndarray, length: int, seed: int):
        starts, width = words.windows(length), length - seed + 1
        self.places, self.heads, self.own = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, width), bool)
        if len(starts):
            heads = window_hashes(hashes, np.arange(len(words) - seed + 1), seed)
            chosen = _leftmost_least(heads, width)[starts]
            self.places, which = np.unique(chosen, return_inverse=True)
            self.heads = heads[self.places]
            self.own = np.zeros((len(self.places), width), bool)
            self.own[which, chosen - starts] = True


CONTEXTS = "bucket int, chunk long, heads binary, right binary, left binary, own binary, places binary, which binary"


def _contexts(chunk: Chunk, words: Words, hashes: np.ndarray, found: Suffixes, hot: np.ndarray, length: int, seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of CONTEXTS for a chunk's suffixes. Equal contexts of the chunk go once, with all their places."""
    left_width = length - seed
    split = left_width // 2
    last = words.first[1:][words.documents_of(found.places)]
    first = words.first[:-1][words.documents_of(found.places)]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    ahead = found.places[:, None] + np.arange(length)
    right = np.where(ahead < last[:, None], short[np.minimum(ahead, len(words) - 1)], 0).astype(">u4")
    behind = found.places[:, None] - 1 - np.arange(left_width)
    left = np.where(behind >= first[:, None], short[np.maximum(behind, 0)], 0).astype("<u4")
    rows, heads, own = np.arange(len(found.places)), found.heads, found.own
    if hot.any():  # passages that reach far to the right are dealt by those words, the others by words to the left
        reach = np.where(np.arange(left_width + 1) <= split, True, False)
        spread = np.flatnonzero(hot)
        more = np.ascontiguousarray(right[spread, : length - split])
        by_right = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in more], np.uint64)
        by_left = np.array([xxhash.xxh3_64_intdigest(r.tobytes(), 1) for r in left[spread, : split + 1]], np.uint64) ^ mix64(heads[spread])
        rows = np.concatenate([np.flatnonzero(~hot), spread, spread])
        heads = np.concatenate([heads[~hot], by_right, by_left])
        own = np.concatenate([own[~hot], own[spread] & reach, own[spread] & ~reach])
        some = own.any(axis=1)
        rows, heads, own = rows[some], heads[some], own[some]
    if not len(rows):
        return
    whole = np.concatenate([heads.astype(">u8").view(np.uint8).reshape(len(rows), 8), right[rows].view(np.uint8), left[rows].view(np.uint8), np.packbits(own, axis=1)], axis=1)
    _, one, which = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    bucket = (heads >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((found.places[rows], which, bucket[one][which]))
    packed = np.packbits(own, axis=1)
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        distinct, number = np.unique(which[part], return_inverse=True)
        picked = one[distinct]
        blobs = (heads[picked], right[rows[picked]], left[rows[picked]], packed[picked], found.places[rows[part]].astype("<i4"), number.astype("<i4"))
        columns = [pa.array([int(bucket[part[0]])], pa.int32()), pa.array([chunk.chunk], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _matches(heads: np.ndarray, right: np.ndarray, left: np.ndarray, owned: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first), shaped as ``owned``: which passages occur again, and which of them is the first of its kind in the given order."""
    n, width = owned.shape
    repeated, first = np.zeros((n, width), bool), np.zeros((n, width), bool)
    rows = np.concatenate([heads.astype(">u8").view(np.uint8).reshape(n, 8), np.ascontiguousarray(right).view(np.uint8).reshape(n, -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    del rows
    common = np.zeros(n - 1, np.int64)
    for at in range(0, n - 1, 1 << 15):
        own = right[order[at : at + (1 << 15) + 1]]
        same = own[1:] == own[:-1]
        common[at : at + len(same)] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    common = np.where(heads[order[1:]] == heads[order[:-1]], common, -1)
    before = np.zeros(n, np.uint64)
    for l in range(width):
        if l:
            before = mix64(before * np.uint64(0x9E3779B97F4A7C15) ^ left[:, l - 1].astype(np.uint64))
        interval = np.zeros(n, np.uint64)
        interval[order] = np.concatenate([[0], np.cumsum(common < length - l)]).astype(np.uint64)
        at = np.flatnonzero(owned[:, l])
        if not len(at):
            continue
        _, lead, group = np.unique(mix64(interval[at] + np.uint64(1)) ^ before[at], return_index=True, return_inverse=True)
        often = np.bincount(group, counts[at]) > 1
        repeated[at, l] = often[group]
        first[at[lead], l] = often
    return repeated, first


def repeated_passages(chunks: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The repeated passages of ``min_words`` words, as replies to the chunks: ``keys`` has the suffixes' places, ``counts`` the bits of ``_matches``."""
    seed = min(seed, min_words)
    total = total_words(chunks)
    bits, fine = bucket_bits(total // 8), bucket_bits(total // 8, 1 << 18)
    width = min_words - seed + 1
    n_bytes = -(-width // 8)

    def heads(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        words = chunk.words()
        yield from _distinct(chunk, Suffixes(words, words.hashes(), min_words, seed).heads, bits, True)

    def send(chunk: Chunk, table: pa.Table) -> Iterator[pa.RecordBatch]:
        repeated, totals = reply_keys(table, bits, True)
        if len(repeated):
            words = chunk.words()
            hashes = words.hashes()
            found = Suffixes(words, hashes, min_words, seed)
            kept = member(found.heads, repeated)
            found.places, found.heads, found.own = found.places[kept], found.heads[kept], found.own[kept]
            if len(found.places):
                hot = (totals[np.searchsorted(repeated, found.heads)] & np.uint32(FIRST - 1)) > HOT
                yield from _contexts(chunk, words, hashes, found, hot, min_words, seed, fine)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        column = lambda name, kind, *shape: [np.frombuffer(x, kind).reshape(-1, *shape) for x in table.column(name).to_pylist()]
        own_heads = column("heads", np.uint64)
        places, which = column("places", "<i4"), column("which", "<i4")
        counts = [np.bincount(w, minlength=len(h)) for w, h in zip(which, own_heads, strict=True)]
        right, left = np.concatenate(column("right", ">u4", min_words)), np.concatenate([np.frombuffer(x, "<u4").reshape(len(h), min_words - seed) for x, h in zip(table.column("left").to_pylist(), own_heads, strict=True)])
        own = np.unpackbits(np.concatenate(column("own", np.uint8, n_bytes)), axis=1, count=width).astype(bool)
        # Contexts of a chunk in the order of their first places, chunks in order.
        firsts = [p[np.unique(w, return_index=True)[1]] for p, w in zip(places, which, strict=True)]
        edges = np.concatenate([[0], np.cumsum([len(h) for h in own_heads])])
        order = np.lexsort((np.concatenate(firsts), np.repeat(np.arange(len(own_heads)), np.diff(edges))))
        repeated, first = np.zeros(own.shape, bool), np.zeros(own.shape, bool)
        repeated[order], first[order] = _matches(np.concatenate(own_heads)[order], right[order], left[order], own[order], np.concatenate(counts)[order], min_words)
        out = []
        for chunk, a, b, p, w in zip(table.column("chunk").to_pylist(), edges[:-1], edges[1:], places, which, strict=True):
            again = repeated[a:b][w]
            lead = np.zeros(len(p), bool)
            lead[np.unique(w, return_index=True)[1]] = True
            some = again.any(axis=1)
            if some.any():
                marks = np.concatenate([np.packbits(again, axis=1), np.packbits(first[a:b][w] & lead[:, None], axis=1)], axis=1)
                out.append((chunk, p[some].tobytes(), marks[some].tobytes()))
        trim()
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "chunk": pa.array([r[0] for r in out], pa.int64()), "keys": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary())})

    mark = written()
    reply = stash(repeated_keys(from_chunks(chunks, heads, KEYS), True), "suffixes", large=True)
    found = stash(over_chunks(chunks, reply, send, CONTEXTS).groupBy("bucket").applyInArrow(compare, KEYS), "passages", large=True)
    discard(chunks.sparkSession, mark, found)
    return found


def _found(chunk: Chunk, table: pa.Table, min_words: int, seed: int = SEED) -> tuple[Words, np.ndarray, np.ndarray]:
    """The chunk's words, which of them lie in a repeated passage, and which in one that isn't the first of its kind.

    The first is the one in the chunk with the smallest number, at its first place there.
    """
    words = chunk.words()
    width = min_words - min(seed, min_words) + 1
    n_bytes = -(-width // 8)
    starts, firsts = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for places, marks in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        bits = np.frombuffer(marks, np.uint8).reshape(-1, 2 * n_bytes)
        again, first = (np.unpackbits(x, axis=1, count=width).astype(bool) for x in (bits[:, :n_bytes], bits[:, n_bytes:]))
        i, l = np.nonzero(again)
        starts.append(np.frombuffer(places, "<i4").astype(np.int64)[i] - l)
        firsts.append(first[i, l])
    at, original = np.concatenate(starts), np.concatenate(firsts)
    return words, covered(len(words), at, min_words), covered(len(words), at[~original], min_words)


def _runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of flagged words, cut where documents meet."""
    if not flags.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    cut = first[(first > 0) & (first < len(flags))]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


SPANS = "doc_id long, start_word long, n_words long, n_repeated long, text string"


def passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal spans of words covered by passages of at least ``min_words`` words that occur again.

    One row for each span: its document, first word, number of words, how many of them a removal that
    keeps the first occurrence takes away, and its text. Documents without one have no row; null and
    empty texts have none. Repeated rows repeat each other's passages.
    """
    chunks = chunk_corpus(docs, id_col, text_col)
    reply = repeated_passages(chunks, min_words)

    def finish(chunk: Chunk, table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, flags, extra = _found(chunk, table, min_words)
        starts, ends = _runs(flags, words.first)
        if len(starts):
            doc = words.documents_of(starts)
            taken = np.concatenate([[0], np.cumsum(extra)])
            raw = words.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.ids[d] for d in doc], pa.int64()),
                    pa.array(starts - words.first[doc], pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(taken[ends] - taken[starts], pa.int64()),
                    pa.array([raw[a:b].decode() for a, b in zip(words.starts[starts], words.ends[ends - 1], strict=True)], pa.string()),
                ],
                names=["doc_id", "start_word", "n_words", "n_repeated", "text"],
            )

    return over_chunks(chunks, reply, finish, SPANS)


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with each repeated passage left only where it occurs first; all columns.

    White space around a removed passage stays. Documents of which no word is left go; a document that
    had none before stays.
    """
    spark, mark = docs.sparkSession, written()
    chunks = chunk_corpus(docs)
    reply = repeated_passages(chunks, min_words)

    def finish(chunk: Chunk, table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, _, extra = _found(chunk, table, min_words)
        starts, ends = _runs(extra, words.first)
        if not len(starts):
            return
        keep = np.zeros(len(words.data) + 1, np.int64)
        np.add.at(keep, words.starts[starts], -1)
        np.add.at(keep, words.ends[ends - 1], 1)
        keep = np.cumsum(keep)[:-1] >= 0
        rows = []
        for d in np.unique(words.documents_of(starts)).tolist():
            a, b = words.offsets[d], words.offsets[d + 1]
            left = int((~extra[words.first[d] : words.first[d + 1]]).sum())
            old = xxhash.xxh64(words.data[a:b].tobytes(), seed=42).intdigest()
            rows.append((chunk.ids[d], old - (1 << 64) if old >> 63 else old, words.data[a:b][keep[a:b]].tobytes().decode() if left else None))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["_id", "_hash", "_text"])

    changed = stash(over_chunks(chunks, reply, finish, "_id long, _hash long, _text string"), "cut-texts")
    # Copies share a hash; the one that keeps most of its text decides, so that it stays once.
    p = prefix_for(docs)
    changed = changed.groupBy("_id", "_hash").agg(F.max_by("_text", F.coalesce(F.length("_text"), F.lit(-1))).alias("_text"), F.lit(True).alias("_changed"))
    changed = stash(changed, "cut-texts")
    discard(spark, mark, changed)
    changed = small(changed, BROADCAST_ROWS // 10, "_text").withColumnsRenamed({c: f"{p}{c[1:]}" for c in ("_id", "_hash", "_text", "_changed")})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(f"{p}hash"))
    joined = docs.join(changed, same, "left").where(F.col(f"{p}changed").isNull() | F.col(f"{p}text").isNotNull())
    return joined.withColumn("text", F.when(F.col(f"{p}changed"), F.col(f"{p}text")).otherwise(F.col("text"))).select(docs.columns)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each maximal span of words, 50 or more, that occurs again: its document, place, length, how much of it a removal takes, and its text. Documents without one have no row."""
    return passages(documents(spark, sf_dir))
