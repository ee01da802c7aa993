"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets are one
class. Two sets with Jaccard similarity t share one of the first ``n - ceil(t n) + 1`` shingles of each in
any common order; ordered by document frequency, those are mostly shingles that occur once and need no
index at all. The others put the class into *tiles*: one for each such shingle and size band (sizes
within a factor of four, and the next band for sizes near its edge, as similar sets can lie across it).

Within a tile every class is compared with one pivot only: the one with the fewest shingles of its own, which
is the original among its copies. A bitmap of ``SIGNATURE_BITS``
parities bounds the overlap from above (each bit that differs is a shingle in one set alone), and pairs
that the bound admits are decided by the exact intersection. Connected components of these links leave
few classes that are not joined to their tile's pivot: *strays*. Strays are compared with each other and
with those joined members that the triangle inequality of the Jaccard distance cannot exclude. So all
links that could join two components are examined, and a group of n linked copies costs n comparisons.
Sizes and a folded bitmap are part of the strays' join condition, so pairs they exclude are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import KEYS, Chunk, bucket_bits, chunk_corpus, components, discard, documents, from_chunks, keys_out, over_chunks, prefix_for, repeated_keys, reply_keys, sequence_hashes, shorten, small, stash, total_words, trim, window_hashes, written

SIGNATURE_BITS = 1024
FOLDED = 8


class ShingleSets:
    """The distinct shingles of each document of a chunk: ``keys[first[d]:first[d + 1]]``, sorted."""

    def __init__(self, chunk: Chunk, size: int):
        words = chunk.words(lower=True)
        hashes, counts = words.hashes(), words.counts
        at = words.windows(size)
        keys, doc = window_hashes(hashes, at, size), words.documents_of(at)
        short = np.flatnonzero((counts > 0) & (counts < size))
        keys = np.concatenate([keys, sequence_hashes(hashes, words.first[short], words.first[short + 1])])
        doc = np.concatenate([doc, short])
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        self.keys, self.doc = keys[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(counts) + 1))
        self.sizes = np.diff(self.first)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.keys)])
        mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.keys * (self.keys >> np.uint64(32) | np.uint64(1)))])
        self.sums = np.diff(total[self.first]).astype(np.int64), np.diff(mixed[self.first]).astype(np.int64)


def signature(keys: np.ndarray, bits: int = SIGNATURE_BITS) -> bytes:
    """A bitmap of the parities of how many keys hash to each bit."""
    return np.packbits(np.bincount((keys % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


SETS = "doc_id long, n_shingles long, s1 long, s2 long, own long, tokens array<bigint>, sig binary, fold array<bigint>, arr binary"


def shingle_sets(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row for each document: its set's size and sums, and for sets that need it the index shingles, bitmap and array."""
    chunks = chunk_corpus(docs, id_col, text_col)
    bits = bucket_bits(total_words(chunks))

    def count(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(chunk, size)
        _, one = np.unique(np.stack([*sets.sums, sets.sizes]), axis=1, return_index=True)
        is_one = np.zeros(len(sets.sizes), bool)
        is_one[one] = True  # copies within the chunk count once
        keys, counts = np.unique(shorten(sets.keys[is_one[sets.doc]], bits, False), return_counts=True)
        if len(keys):
            yield keys_out(chunk.chunk, keys, counts, bits, False)

    reply = stash(repeated_keys(from_chunks(chunks, count, KEYS), False), "frequencies", large=True)

    def index(chunk: Chunk, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(chunk, size)
        shared, totals = reply_keys(table, bits, False)
        short = shorten(sets.keys, bits, False)
        often = np.ones(len(short), np.int64)
        if len(shared):
            at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
            often = np.where(shared[at] == short, totals[at] & np.uint32(0x7FFFFFFF), 1).astype(np.int64)
        prefix = sets.sizes - -(-percent * sets.sizes // 100) + 1
        unique = np.bincount(sets.doc[often == 1], minlength=len(sets.sizes))
        tokens, sigs, folds, arrays = [], [], [], []
        for d, need in enumerate((prefix - unique).tolist()):
            if not sets.sizes[d] or need <= 0:
                tokens.append(None), sigs.append(None), folds.append(None), arrays.append(None)
                continue
            own = slice(sets.first[d], sets.first[d + 1])
            keys, df = short[own], often[own]
            keys, df = keys[df > 1], df[df > 1]
            tokens.append(keys[np.lexsort((keys, df))[:need]].astype(np.int64))
            sigs.append(signature(sets.keys[own]))
            # The parities of a smaller bitmap are those of its parts taken together.
            folds.append(np.bitwise_xor.reduce(np.frombuffer(sigs[-1], np.int64).reshape(-1, FOLDED), axis=0))
            arrays.append(sets.keys[own].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, pa.int64()), pa.array(sets.sizes, pa.int64()), pa.array(sets.sums[0]), pa.array(sets.sums[1]), pa.array(unique.astype(np.int64)), pa.array(tokens, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.array(arrays, pa.binary())],
            names=[x.split()[0] for x in SETS.split(", ")],
        )

    return stash(over_chunks(chunks, reply, index, SETS), "sets", large=True)


def _bounded(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Adds ``most``, an upper bound of the similarity of a and b from sizes and bitmaps, to pairs (a, b)."""
    x = sigs.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    y = sigs.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb = (t.column(k).to_numpy() for k in ("na", "nb"))
            left, right = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint64).reshape(t.num_rows, -1) for k in ("sa", "sb"))
            differ = np.bitwise_count(left ^ right).sum(axis=1).astype(np.int64)
            overlap = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(np.maximum(overlap, 0) / (na + nb - np.maximum(overlap, 0)))], names=["a", "b", "most"])
        trim()

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, most double")


def _exact(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The exact similarity of pairs (a, b), as overlap and union."""
    x = arrays.select(F.col("doc_id").alias("a"), F.col("arr").alias("xa"))
    y = arrays.select(F.col("doc_id").alias("b"), F.col("arr").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            both, union = [], []
            for p, q in zip(t.column("xa"), t.column("xb"), strict=True):
                left, right = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(left) > len(right):
                    left, right = right, left
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                n = int((right[at] == left).sum())
                both.append(n)
                union.append(len(left) + len(right) - n)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "overlap", "total"])
        trim()

    return pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, overlap long, total long")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(a, b, most, linked): the similarity or its bound, and whether it reaches the threshold."""
    bounded = stash(_bounded(pairs, sets.select("doc_id", "n_shingles", "sig"), percent), f"{name}-bounds")
    near = bounded.where(F.col("most") >= percent / 100 - 1e-9)
    decided = stash(_exact(near.select("a", "b"), sets.select("doc_id", "arr")), f"{name}-exact")
    decided = decided.select("a", "b", (F.col("overlap") / F.col("total")).alias("similarity"), (100 * F.col("overlap") >= percent * F.col("total")).alias("linked"))
    return stash(bounded.join(decided, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", "most").alias("most"), F.coalesce("linked", F.lit(False)).alias("linked")), name)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document, linked where the Jaccard similarity of shingle sets reaches ``percent``.

    ``component_id`` is the smallest id reachable by links. Null and empty texts have no shingles and no
    links; a text of fewer than ``size`` words is one shingle. Rows with the same id are one node; a null
    id is linked to nothing and has a null component.
    """
    sets = shingle_sets(docs, size, percent, id_col, text_col)
    classes = stash(sets.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("own").alias("own"), F.first("tokens").alias("tokens")), "classes")
    band = F.floor(F.log(4.0, F.col("n_shingles").cast("double")) + 1e-12)
    edge = F.pow(F.lit(4.0), band + 1) * (percent / 100) <= F.col("n_shingles")
    bands = F.when(edge, F.array(band, band + 1)).otherwise(F.array(band))
    tiles = classes.select("rep", "own", "n_shingles", F.explode("tokens").alias("token"), bands.alias("bands")).select("rep", "own", "n_shingles", "token", F.explode("bands").alias("band"))
    tiles = stash(tiles, "tiles")
    pivots = tiles.groupBy("token", "band").agg(F.min(F.struct("own", "rep"))["rep"].alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stash(tiles.join(pivots, ["token", "band"]).where("rep <> pivot"), "members")
    # Only classes that share a tile need their arrays; a class is read once, from its smallest document.
    needed = members.select(F.col("rep").alias("doc_id")).union(members.select(F.col("pivot").alias("doc_id"))).distinct()
    held = sets.where("tokens is not null").select("doc_id", "n_shingles", "sig", "fold", "arr")
    held = stash(held.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "held")
    star = _compared(members.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), held, percent, "star")
    links = star.where("linked").select("a", "b")
    labels = components(links)
    label = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_label"))
    folds = held.select(F.col("doc_id").alias("a"), "fold")
    seen = members.withColumnsRenamed({"rep": "a", "pivot": "b"}).join(star, ["a", "b"]).join(folds, "a").join(label("a"), "a", "left").join(label("b"), "b", "left")
    seen = stash(seen.select("token", "band", "a", "n_shingles", "fold", F.coalesce("a_label", "a").alias("label"), "most", "linked", (F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).alias("stray")), "seen")
    reach = 1 - percent / 100
    strays = stash(seen.where("stray"), "strays")
    nearest = strays.groupBy("token", "band").agg(F.min(1 - F.col("most")).alias("nearest"))
    edge_members = seen.where("not stray").join(nearest, ["token", "band"]).where(~F.col("linked") | (1 - F.col("most") >= F.col("nearest") - reach - 1e-9))
    columns = [F.col("a").alias("b"), F.col("label").alias("b_label"), F.col("n_shingles").alias("b_n"), *(F.col("fold")[k].alias(f"g{k}") for k in range(FOLDED))]
    others = strays.select("token", "band", *columns, F.lit(True).alias("both")).union(edge_members.select("token", "band", *columns, F.lit(False)))
    near_size = 100 * F.least("n_shingles", "b_n") >= percent * F.greatest("n_shingles", "b_n")
    differ = sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}"))) for k in range(1, FOLDED)), F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))))
    total = F.col("n_shingles") + F.col("b_n")
    near_bits = (100 + percent) * (total - differ) >= 2 * percent * total  # overlap at most (total - differ) / 2
    apart = (F.col("label") != F.col("b_label")) & (~F.col("both") | (F.col("a") < F.col("b"))) & near_size & near_bits
    again = strays.select("token", "band", "a", "n_shingles", "label", *(F.col("fold")[k].alias(f"f{k}") for k in range(FOLDED))).join(stash(others, "others"), ["token", "band"]).where(apart)
    again = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _compared(again, held, percent, "strays").where("linked").select("a", "b")
    labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    own = sets.select("doc_id", "n_shingles", "s1", "s2")
    out = own.join(named, ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those linked to one with a smaller id; rows with equal ids share a fate."""
    own, spark, mark = f"{prefix_for(docs)}id", docs.sparkSession, written()
    found = jaccard_components(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    gone = stash(found, "near-duplicates")
    discard(spark, mark, gone)
    gone = small(gone, 1_000_000)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size of its set of four-word shingles and the smallest id that it is linked with, at 85 in a hundred. Null and empty texts have no shingles and stand alone; rows with equal ids are one node."""
    return jaccard_components(documents(spark, sf_dir), size=4, percent=85)
