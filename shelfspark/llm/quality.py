"""Quality rules: cross-document line frequency within hosts, beside per-document statistics.

Each line is normalised (A-Z lower-cased, digits as 0, runs of white space as one) and hashed. For each
host (the ``source`` column) the distinct documents that have a line are counted; copies of a text are
documents of their own. A line is boilerplate of its host if more than ``LINE_DOCS`` documents have it, or
``LEAST_DOCS`` of them and more than ``LINE_SHARE`` of the host's documents, so small hosts have a limit too.
It is removed from every document; with ``keep_first`` from all but the host's first one, by the order of
doc_id, text and line. A document that loses more than ``DEPLETED`` of its words that way is rejected, as is
one that fails the base rules (too few words, too many repeated words).

Hashes have 64 bits; a collision could only make a rare line count as a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Words, arrow_limits, byte_hashes, discard, documents, mix64, prefix_for, sequence_hashes, slices, small, stash, string_buffers, trim, window_hashes, written

LINE_DOCS = 1000
LINE_SHARE = 0.05
LEAST_DOCS = 3
DEPLETED = 0.2
MIN_WORDS = 50
#: Frequent lines up to this number go to every task; more are joined by a salted shuffle.
BROADCAST_LINES = 500_000
SALTS = 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48

STATS = "row long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<bigint>, line_words array<int>, line_at array<int>"


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


def slice_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list[np.ndarray]]:
    """The base statistics and the lines of a run of documents."""
    words = Words(data, offsets)
    n_docs, n = len(offsets) - 1, len(data)
    lead = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.concatenate([[0], np.cumsum(lead[words.ends] - lead[words.starts])])[words.first]
    # Lines: from a document's start or a line feed to the next one, those with a word.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if n else ends
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(doc, np.arange(n_docs))[doc] if len(starts) else np.zeros(0, np.int64)
    first_word, last_word = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = last_word > first_word
    starts, ends, doc, number, first_word, last_word = (x[full] for x in (starts, ends, doc, number, first_word, last_word))
    exact = byte_hashes(data, starts, ends)
    order = np.lexsort((exact, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (exact[order][1:] == exact[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    line_edges = np.searchsorted(doc, np.arange(n_docs + 1))
    folded = Words(_FOLD[data], offsets)
    normal = sequence_hashes(folded.hashes(), first_word, last_word)
    # Words in a 3-word window that the document has twice.
    at = words.windows(3)
    own = words.documents_of(at)
    keys = window_hashes(words.hashes(), at, 3) ^ mix64(own.astype(np.uint64) + np.uint64(1))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = at[counts[inverse] > 1] if len(at) else at
    cover = np.zeros(len(words) + 3, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    repeated = np.cumsum(cover)[: len(words)] > 0
    cut = line_edges[1:-1]
    return {
        "n_words": words.counts,
        "word_chars": np.diff(chars),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc[order][again], minlength=n_docs),
        "n_repeat_words": _sums(repeated, words.first),
        "lines": np.split(normal.astype(np.int64), cut),
        "line_words": np.split((last_word - first_word).astype(np.int32), cut),
        "line_at": np.split(number.astype(np.int32), cut),
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One written row for each document, with its statistics and the hashes of its lines; a null text is empty, a null host is one."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = string_buffers(b.column(3))
            for first, last, piece, own in slices(data, offsets):
                s = slice_statistics(piece, own)
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        *(b.column(k).slice(first, n) for k in range(3)),
                        *(pa.array(np.asarray(s[k], np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        pa.array(s["lines"], pa.list_(pa.int64())),
                        pa.array(s["line_words"], pa.list_(pa.int32())),
                        pa.array(s["line_at"], pa.list_(pa.int32())),
                    ],
                    names=[x.split()[0] for x in STATS.split(", ")],
                )
                row += n
        trim()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return stash(slim.mapInArrow(run, STATS), "statistics")


def frequent_lines(stats: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line, first, docs) of the lines above the limits; ``first`` is the host's first (doc_id, text_hash) with the line.

    Rows with equal ids and texts are one document; rows without an id are documents of their own.
    """
    one = F.coalesce(F.col("doc_id"), F.lit(-1) - F.col("row"))
    texts = stats.select("host", one.alias("doc_id"), "text_hash", "lines").dropDuplicates(["host", "doc_id", "text_hash"])
    sizes = texts.groupBy("host").agg(F.count("*").alias("documents"))
    lines = texts.select("host", "doc_id", "text_hash", F.explode(F.array_distinct("lines")).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "text_hash")).alias("first")).where(F.col("docs") >= min(LEAST_DOCS, line_docs + 1))
    limit = F.least(F.lit(float(line_docs)), F.greatest(F.lit(LEAST_DOCS - 1.0), F.col("documents") * line_share))
    often = counted.join(sizes, "host").where(F.col("docs") > limit)
    return stash(often.select("host", "line", "first", "docs"), "frequent-lines")


def verdicts(stats: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED, keep_first: bool = True) -> DataFrame:
    """``stats`` with base_failed, kept, n_removed_words and removed_at (numbers of the lines to remove)."""
    often = frequent_lines(stats, line_docs, line_share)
    one = F.coalesce(F.col("doc_id"), F.lit(-1) - F.col("row"))
    lines = stats.select("row", "host", F.struct(one.alias("doc_id"), "text_hash").alias("own"), F.explode(F.arrays_zip("lines", "line_words", "line_at")).alias("l"))
    lines = lines.select("row", "host", "own", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"), F.col("l.line_at").alias("at"))
    if often.count() <= BROADCAST_LINES:  # rows of two hashes, a short name and an id
        found = lines.join(F.broadcast(often), ["host", "line"])
    else:  # a line that a third of the documents have is spread over the salts
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    if keep_first:
        found = found.where(F.col("own") != F.col("first"))
    lost = found.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("at")).alias("removed_at"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.drop("lines", "line_words", "line_at").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("n_removed_words") <= depleted * F.col("n_words")))


def quality_filter(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, keep_first: bool = True) -> DataFrame:
    """The documents that are kept, all columns, with the removed lines gone from their texts. Repeated rows share a fate."""
    p, spark, mark = prefix_for(docs), docs.sparkSession, written()
    found = verdicts(statistics(docs), line_docs, line_share, keep_first=keep_first)
    changed = found.where(~F.col("kept") | (F.size("removed_at") > 0)).groupBy("doc_id", "host", "text_hash").agg(F.min("kept").alias(f"{p}kept"), F.min("removed_at").alias(f"{p}removed"))
    changed = stash(changed.withColumnsRenamed({"doc_id": f"{p}id", "host": f"{p}host", "text_hash": f"{p}hash"}), "verdicts")
    discard(spark, mark, changed)
    changed = small(changed, BROADCAST_LINES, f"{p}removed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(f"{p}host")) & (F.xxhash64(text) == F.col(f"{p}hash"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(f"{p}removed"), i)), "\n")
    joined = docs.join(changed, same, "left").where(F.coalesce(f"{p}kept", F.lit(True)))
    return joined.withColumn("text", F.when(F.size(f"{p}removed") > 0, left).otherwise(F.col("text"))).select(docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics and the verdict for every document; ``n_removed_words`` are the words of its removed lines."""
    found = verdicts(statistics(documents(spark, sf_dir)), keep_first=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
