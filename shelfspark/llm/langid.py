"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built from labelled text. A text is parsed greedily into the
longest phrases that occur in the training text. A language's score is its number of phrases for each
symbol of the text, times what it costs to name a phrase: the logarithm of the training text's length, since
a longer one has longer matches, and that of the number of symbols. The language with the least wins. The
automata are tables (state, symbol) -> state for the most frequent letters and sorted arcs for all others, and
a text is parsed in segments of ``SEGMENT`` symbols, all segments of a batch in step.

The classifier is fitted on a bounded sample: ``SAMPLE_DOCS`` texts for each language, those with the
smallest hash of their id, ``SAMPLE_CHARS`` characters of each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import arrow_limits, documents

SAMPLE_DOCS = 48
SAMPLE_CHARS = 1500
#: Columns of the tables; letters beyond these have sorted arcs.
SYMBOLS = 64
SEGMENT = 512
OTHER = SYMBOLS - 1
_LETTER = np.zeros(0x110000, bool)
_LOWER = np.zeros(0, np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case (where it is one character)."""
    global _LOWER
    if not len(_LOWER):
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                _LETTER[c] = True
                small = chr(c).lower()
                if len(small) == 1:
                    lower[c] = ord(small)
        _LOWER = lower
    return _LETTER, _LOWER


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fold(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one 0."""
    letter, lower = _tables()
    codes = _code_points(text)
    is_letter = letter[codes]
    folded = np.where(is_letter, lower[codes], 0)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return folded[keep]


def _arcs(symbols: np.ndarray) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a sequence."""
    size = 2 * len(symbols) + 1
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and s not in go[p]:
            go[p][s] = new
            p = link[p]
        if p != -1:
            q = go[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(s) == q:
                    go[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    assert len(go) <= size
    return go


def _table(go: list[dict[int, int]], n_symbols: int) -> np.ndarray:
    table = np.full((len(go) + 1, n_symbols), -1, np.int32)
    for state, arcs in enumerate(go):
        for s, to in arcs.items():
            if s < n_symbols:
                table[state, s] = to
    return table


def suffix_automaton(symbols: np.ndarray, n_symbols: int = SYMBOLS) -> np.ndarray:
    """Transitions (state, symbol) -> state of the suffix automaton of a sequence, -1 where there is none.

    The last state has no transitions; the parse waits there after a symbol that the sequence lacks.
    """
    return _table(_arcs(symbols), n_symbols)


class RareArcs:
    """Transitions by the symbols from SYMBOLS on, as sorted pairs (state, symbol)."""

    def __init__(self, go: list[dict[int, int]]):
        arcs = sorted((state << 32 | s, to) for state, own in enumerate(go) for s, to in own.items() if s >= SYMBOLS)
        self.keys = np.array([k for k, _ in arcs], np.int64)
        self.to = np.array([t for _, t in arcs], np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        wanted = state << 32 | symbol
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.to[at], -1)


def phrase_counts(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, rare: RareArcs | None = None) -> np.ndarray:
    """Greedy longest-match phrases of each row of symbols, its first ``lengths`` symbols, parsed in step.

    With ``rare``, symbols from SYMBOLS on are looked up there; the table's last column is theirs and empty. Rows are ordered by falling length, so the rows still being parsed are always the first ones.
    """
    n, width = rows.shape
    flat, columns = table.ravel(), np.ascontiguousarray(rows.T).astype(np.int64)
    root = np.where(table[0] < 0, len(table) - 1, table[0]).astype(np.int64)
    state = np.zeros(n, np.int64)
    phrases = (lengths > 0).astype(np.int64)
    for j in range(width):
        live = int(np.searchsorted(-lengths, -j, side="left"))
        if not live:
            break
        symbol = columns[j, :live]
        column = symbol if rare is None else np.minimum(symbol, OTHER)
        to = flat[state[:live] * table.shape[1] + column]
        seldom = np.flatnonzero(symbol >= SYMBOLS) if rare is not None else symbol[:0]
        if len(seldom):
            to[seldom] = rare.step(state[seldom], symbol[seldom])
        broken = np.flatnonzero(to < 0)
        phrases[broken] += 1 if j else 0
        to[broken] = root[column[broken]]
        if len(seldom):
            again = broken[symbol[broken] >= SYMBOLS]
            start = rare.step(np.zeros(len(again), np.int64), symbol[again])
            to[again] = np.where(start < 0, len(table) - 1, start)
        state[:live] = to
    return phrases


class CrossParser:
    """A fitted classifier: one suffix automaton for each language."""

    def __init__(self, training: dict[str, list[str]]):
        folded = {k: [fold(t) for t in texts] for k, texts in sorted(training.items())}
        often = Counter(c for parts in folded.values() for p in parts for c in p.tolist())
        often.pop(0, None)
        letters = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))]
        self.symbol = np.full(0x110000, OTHER, np.uint32)  # a letter that no training text has is a phrase of its own
        self.symbol[0] = 0
        for i, c in enumerate(letters):
            self.symbol[c] = i + 1 if i + 1 < OTHER else i + 2
        self.languages = list(folded)
        joined = {k: np.concatenate([x for p in parts for x in (p, [0])] or [[0]]).astype(np.int64) for k, parts in folded.items()}
        automata = [_arcs(self.symbol[joined[k]]) for k in self.languages]
        self.tables = [_table(go, SYMBOLS) for go in automata]
        self.rare = [RareArcs(go) for go in automata]
        self.cost = [float(np.log(len(joined[k]) + 1) + np.log(len(letters) + 2)) for k in self.languages]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 (how far the runner-up is behind) for each text."""
        out_lang, out_score = ["und"] * len(texts), [0.0] * len(texts)
        letter, _ = _tables()
        rows: list[np.ndarray] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            symbols = self.symbol[fold(t)] if t else np.zeros(0, np.uint32)
            if t and self.languages and (symbols != 0).any():
                cut = [symbols[k : k + SEGMENT] for k in range(0, len(symbols), SEGMENT)]
                rows += cut
                owner += [i] * len(cut)
        if not rows:
            return out_lang, out_score
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(-lengths, kind="stable")
        table = np.zeros((len(rows), SEGMENT), np.uint32)
        for at, k in enumerate(order):
            table[at, : lengths[k]] = rows[k]
        owners, lengths = np.array(owner)[order], lengths[order]
        totals = np.bincount(owners, weights=lengths, minlength=len(texts))
        counts = np.stack([np.bincount(owners, weights=phrase_counts(table, lengths, t, r), minlength=len(texts)) * c for t, r, c in zip(self.tables, self.rare, self.cost, strict=True)])
        for i in np.flatnonzero(totals):
            rate = counts[:, i] / totals[i]
            best = int(np.argmin(rate))
            rest = np.delete(rate, best)
            out_lang[i] = self.languages[best]
            out_score[i] = 1.0 if not len(rest) else float(min(1.0, max(0.0, 1 - rate[best] / rest.min())))
        return out_lang, out_score


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """The bounded training sample of rows (doc_id, text, lang), taken without moving other rows' texts.

    Each task keeps the ``docs`` smallest hashes for each language; of those the smallest remain.
    """
    arrow_limits(labelled.sparkSession)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, str]]] = {}
        for b in batches:
            for key, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held.setdefault(lang, [])
                own.append((key, text[:chars]))
                if len(own) >= 4 * docs:
                    own.sort()
                    del own[docs:]
        rows = [(k, lang, t) for lang, own in held.items() for k, t in sorted(own)[:docs]]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["k", "lang", "text"])

    usable = labelled.where("text is not null and lang is not null").select(F.xxhash64("doc_id", "text").alias("k"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kept = usable.mapInArrow(least, "k long, lang string, text string")
    first = Window.partitionBy("lang").orderBy("k", "text")
    out: dict[str, list[str]] = {}
    for r in kept.withColumn("at", F.row_number().over(first)).where(F.col("at") <= docs).orderBy("lang", "at").select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def held_out(column: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


_parsers: dict[int, CrossParser] = {}


def identify(df: DataFrame, training: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; ``und`` and 0 for a null text, one without letters, or no training text.

    Equal texts get equal results; ties between languages go to the first in alphabetical order.
    """
    arrow_limits(df.sparkSession)
    key = zlib.crc32(repr(sorted(training.items())).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(training)
        for b in batches:
            texts, langs, scores = b.column(1).to_pylist(), [], []
            at = 0
            while at < len(texts):  # about 4 million characters at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                lang, score = _parsers[key].predict(texts[at:end])
                langs += lang
                scores += score
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it was held out, the language learnt from the others that parses its text in the fewest phrases, and a score. ``und`` and 0 for a null text or one without letters."""
    docs = documents(spark, sf_dir)
    training = sample(docs.where(~held_out()))
    return identify(docs, training).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
