"""Shared ground of the training-data operators.

Three ideas carry most of the work:

* *Vectorised words.*  A slice of an Arrow string column is hashed word by word with numpy
  over its raw UTF-8 bytes, so no Python object is made per word.
* *Chunks.*  ``chunk_corpus`` writes the corpus once as compressed chunks of a few MB.  A chunk
  is the unit in which keys are pre-aggregated before any shuffle.
* *Key exchange.*  ``repeated_keys`` deals every chunk's distinct keys to buckets by hash and
  sends back, to each chunk that holds it, every key that occurs at least twice.  A chunk sends a
  key once however often it holds it, so no key gathers more rows than there are chunks.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 512 << 10
CHUNK_BYTES = 1 << 20

_local_workspace: list[str] = []
_tables = threading.local()  # the tables that each thread of the driver has written


# --- session helpers -------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a folder, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch can hold, so long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/shelfspark"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_workspace:
        _local_workspace.append(tempfile.mkdtemp(prefix="shelfspark-"))
    return f"file://{_local_workspace[0]}"


def _written() -> list[str]:
    if not hasattr(_tables, "paths"):
        _tables.paths = []
    return _tables.paths


def written() -> int:
    """A mark in the sequence of tables that this thread has written, for ``discard``."""
    return len(_written())


def discard(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Removes the tables written since a mark but for ``keep``, written ones: they don't need the ones they were made from."""
    held = {df._stash for df in keep}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _written()[since:]:
        if path not in held:
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written()[since:] = [p for p in _written()[since:] if p in held]


def stash(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Writes a table to the workspace and returns a reader of it, which cuts the lineage.

    Shuffle files of the finished step are released by a collection on both sides; after a large
    step Spark's cleaner gets a moment, so that two such steps don't lie on disk together.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written().append(path)
    schema = df.schema
    del df
    for _ in range(1 + large):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if large and not spark.sparkContext.master.startswith("local["):
            time.sleep(0.5)
    out = spark.read.schema(schema).parquet(path)
    out._stash = path
    return out


def prefix_for(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that are joined to it for a time."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, since workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


# --- words -----------------------------------------------------------------------------------

_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents 0 to n."""
    if _powers["n"] < n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.empty(size, np.uint64)
            table[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done : done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _powers[key] = table
        _powers["n"] = size - 1
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of documents, as spans of one byte buffer.

    ``first[d]:first[d + 1]`` are the words of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets = offsets.astype(np.int64)
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = ~_SPACE[data]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[cuts] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return byte_hashes(self.data, self.starts, self.ends)

    def windows(self, length: int) -> np.ndarray:
        """Indices of words at which a window of that many words of one document starts."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self), dtype=np.int64)
        return at[at + length <= last]

    def documents_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


#: Codes after which a span is hashed by itself and not together with others.
LONG_SPAN = 512
#: Codes of a window that one running sum may hash: patterns that cancel out modulo 2**64 need over a thousand.
RUN = 64


def _chained(n: np.ndarray, code: Callable[[int, np.ndarray], np.ndarray], whole: Callable[[int], bytes]) -> np.ndarray:
    """Hashes of spans of ``n`` codes: each code is mixed into the state by a bijection, so no arithmetic pattern cancels out.

    ``code(j, of)`` are the j-th codes of the spans ``of``; ``whole(i)`` are the bytes of a span longer than LONG_SPAN.
    """
    state = mix64(n.astype(np.uint64))
    order = np.argsort(-n, kind="stable")
    left = n[order]
    tall = int(np.searchsorted(-left, -LONG_SPAN, side="left"))
    for i in order[:tall].tolist():
        state[i] = xxhash.xxh3_64_intdigest(whole(i))
    order, left = order[tall:], left[tall:]
    own = state[order]
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -j, side="left"))
        own[:live] = mix64(own[:live] * np.uint64(_BASE) ^ code(j, order[:live]))
    state[order] = own
    return state


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts

    def code(j: int, of: np.ndarray) -> np.ndarray:
        beyond = np.maximum(8 * (j + 1) - sizes[of], 0).astype(np.uint64)
        return eight[starts[of] + 8 * j] & (np.uint64(_MASK) >> (beyond << np.uint64(3)))

    mixed = _chained(-(-sizes // 8), code, lambda i: data[starts[i] : ends[i]].tobytes())
    return mix64(mixed + sizes.astype(np.uint64) * np.uint64(_BASE))


def sequence_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of 64-bit codes, of any length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return _chained(ends - starts, lambda j, of: codes[starts[of] + j], lambda i: codes[starts[i] : ends[i]].tobytes())


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of at most RUN codes, from one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(codes))
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the windows of ``length`` word hashes that start at ``at``."""
    if length <= RUN:
        return span_hashes(words, at, at + length)
    parts = span_hashes(words, np.arange(len(words) - RUN + 1), np.arange(RUN, len(words) + 1)) if len(at) else at.astype(np.uint64)
    state = mix64(np.full(len(at), length, np.uint64))
    for j in [*range(0, length - RUN, RUN), length - RUN]:
        state = mix64(state * np.uint64(_BASE) ^ parts[at + j])
    return state


#: Bytes of texts that may be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, payload: str | None = None) -> DataFrame:
    """Marks a written table for broadcasting if it has at most so many rows and, where it carries texts or arrays of numbers, BROADCAST_BYTES of them; a larger one is joined by a shuffle."""
    size = F.lit(0)
    if payload:
        size = F.sum(F.octet_length(payload) if df.schema[payload].dataType.typeName() == "string" else 8 * F.size(payload))
    n, held = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= BROADCAST_BYTES else df


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts documents into runs of about ``limit`` bytes; a longer document is a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# --- chunks ----------------------------------------------------------------------------------

CHUNKS = "chunk long, ids array<bigint>, sizes array<bigint>, n_words long, ztext binary"


def chunk_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """The corpus as rows of about ``limit`` bytes of text, compressed, written to the workspace."""
    arrow_limits(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            lengths = np.concatenate(sizes)
            words = len(Words(data, np.concatenate([[0], np.cumsum(lengths)])))
            row = pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([(part << 32) | seq], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                    "sizes": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths)),
                    "n_words": pa.array([words], pa.int64()),
                    "ztext": pa.array([pack.compress(data.tobytes())], pa.binary()),
                }
            )
            seq += 1
            ids.clear(), parts.clear(), sizes.clear()
            return row

        held = 0
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            keys = batch.column(0)
            for first, last, piece, own in slices(data, offsets, limit):
                if held and held + len(piece) > limit:
                    yield flush()
                    held = 0
                ids.append(keys.slice(first, last - first))
                parts.append(piece.copy())
                sizes.append(np.diff(own))
                held += len(piece)
        if ids:
            yield flush()
        trim()

    slim = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return stash(slim.mapInArrow(cut, CHUNKS), "chunks")


class Chunk:
    """One row of ``chunk_corpus``."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ids: list[int | None] = row["ids"]
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ztext"], max_output_size=int(self.sizes.sum()) or 1), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def words(self, lower: bool = False) -> Words:
        return Words(self.data, self.offsets, lower)


def chunk_rows(table: pa.Table | pa.RecordBatch) -> Iterator[Chunk]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


# --- key exchange ----------------------------------------------------------------------------

KEYS = "bucket int, chunk long, keys binary, counts binary"
FIRST = 1 << 31


def bucket_bits(n_keys: int, per_bucket: int = 1 << 20) -> int:
    """Bits for so many buckets that one holds about ``per_bucket`` keys, 64 buckets at least."""
    return max(6, int(np.ceil(np.log2(max(1, n_keys) / per_bucket))))


def total_words(chunks: DataFrame) -> int:
    return int(chunks.agg(F.sum("n_words")).first()[0] or 0)


def shorten(keys: np.ndarray, bits: int, wide: bool) -> np.ndarray:
    """Keys as the exchange compares them: whole, or the bucket's bits and 32 more."""
    return keys if wide else keys >> np.uint64(32 - bits)


def keys_out(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int, wide: bool) -> pa.RecordBatch:
    """Rows of KEYS for the sorted distinct keys of a chunk (already shortened) and their counts."""
    width = 64 if wide else 32 + bits
    bucket = (keys >> np.uint64(width - bits)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    full, edges = bucket[firsts], np.append(firsts, len(bucket))
    body = keys if wide else (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(full.astype(np.int32)),
            "chunk": pa.array(np.full(len(full), chunk, np.int64)),
            "keys": pa.array([body[a:b].tobytes() for a, b in pairwise(edges)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in pairwise(edges)], pa.binary()),
        }
    )


def repeated_keys(keyed: DataFrame, wide: bool) -> DataFrame:
    """From rows of KEYS, the keys that occur at least twice, sent back to each chunk that holds them.

    ``counts`` of the result are unsigned 32-bit: the total over all chunks in the lower 31 bits, and
    the top bit set in the chunk with the smallest number that holds the key.
    """
    kind = np.uint64 if wide else np.uint32

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        blobs = table.column("keys").to_pylist()
        sizes = np.array([len(x) // kind().itemsize for x in blobs])
        keys = np.frombuffer(b"".join(blobs), kind)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.empty(len(keys), bool)
        new[:1] = True
        new[1:] = ordered[1:] != ordered[:-1]
        sums = np.add.reduceat(counts[order].astype(np.uint32), np.flatnonzero(new)) if len(keys) else np.zeros(0, np.uint32)
        total = np.empty(len(keys), np.uint32)
        total[order] = sums[np.cumsum(new) - 1] if len(keys) else 0
        keep = total >= 2
        total[order[new]] |= np.uint32(FIRST)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        rows = [(c, keys[a:b][keep[a:b]], total[a:b][keep[a:b]]) for c, a, b in zip(chunk, edges[:-1], edges[1:], strict=True)]
        rows = [r for r in rows if len(r[1])]
        trim()
        return pa.table(
            {
                "bucket": pa.array([bucket] * len(rows), pa.int32()),
                "chunk": pa.array([r[0] for r in rows], pa.int64()),
                "keys": pa.array([r[1].tobytes() for r in rows], pa.binary()),
                "counts": pa.array([r[2].tobytes() for r in rows], pa.binary()),
            }
        )

    return keyed.groupBy("bucket").applyInArrow(reduce, KEYS)


def reply_keys(table: pa.Table, bits: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sorted repeated keys that came back to one chunk, and their totals."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, counts = [], []
    for bucket, k, c in zip(*(table.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
        own = np.frombuffer(k, np.uint64) if wide else np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(bucket << 32)
        keys.append(own)
        counts.append(np.frombuffer(c, np.uint32))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in a sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def over_chunks(chunks: DataFrame, reply: DataFrame, work: Callable[[Chunk, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(chunk, its reply)`` for each chunk; a chunk without a reply gets an empty table."""
    empty = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    def run(left: pa.Table, right: pa.Table):
        out = [b for c in chunk_rows(left) for b in work(c, right if right.num_rows else empty)]
        trim()
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], t) for n, t in out_types})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    out_types = [(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)]
    return chunks.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(run, schema)


def from_chunks(chunks: DataFrame, work: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(chunk)`` for each chunk, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunk_rows(batch):
                yield from work(c)
                trim()

    return chunks.mapInArrow(run, schema)


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the smallest reachable node.

    Each round takes the least label among neighbours and then jumps to the label's own label, so
    the number of rounds grows with the logarithm of the longest path. Rounds are written to the
    workspace, so a lost executor costs one round at most. An empty edge table gives an empty result.
    """
    spark, mark = edges.sparkSession, written()
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = stash(both.union(both.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = stash(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = least.join(jump, "component", "left").select("node", "was", F.least("component", "further").alias("component"))
        moved = stash(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            discard(spark, mark, moved)
            labels._stash = moved._stash
            return labels
