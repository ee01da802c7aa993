"""BPE encoding and decoding with a merge automaton.

``MergeAutomaton`` is compiled by taking the merges in order. Each merge (u, v) -> w is a gadget on
the automaton over tokens: the state behind u loses its arc v, and every state with an arc u gets an
arc w to the state behind v. A state therefore depends only on the token read last, and is the state
of some earlier token less the arcs removed since. The gadgets are kept in that form (which pair
removes an arc, when, and whose state a new token takes over) and arcs are read from them on demand
into a transition table, since the full table would have the square of the vocabulary as entries.

Every string is the label of exactly one path, so encoding extends, symbol by symbol, the one path
that reaches each position. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .core import arrow_limits, documents

VOCABULARY = "word_bpe_49k.json"
#: Words kept by a worker with their tokens; it starts anew when full.
CACHE_WORDS = 300_000
#: A text with none of these is its own NFC form, and its letters, digits and spaces are the same in every Unicode version.
_UNSETTLED = regex.compile("[̀-\U0010ffff]")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The deterministic automaton of a list of merges, by successive merge gadgets."""

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.removes: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        made = [vocab[a + b] for a, b in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make the same token")
        live = set(self.label) - set(made)
        for rank, ((a, b), w) in enumerate(zip(merges, made, strict=True)):
            u, v = vocab[a], vocab[b]
            if u in live and v in live and self._has_arc(u, v, rank - 1):
                self.removes[u, v] = rank
                self.left[w], self.right[w], self.born[w] = u, v, rank
                live.add(w)
        self.trie: dict[tuple[int, str], int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i in live:
            node = 0
            for symbol in self.symbols(self.label[i]):
                if (node, symbol) not in self.trie:
                    self.trie[node, symbol] = nodes
                    nodes += 1
                node = self.trie[node, symbol]
            self.token_at[node] = i

    @staticmethod
    def symbols(text: str) -> list[str]:
        """A token or word as symbols: single characters, the last with the end mark if there is one."""
        if text.endswith("</w>") and len(text) > 4:
            return [*text[:-5], text[-5:]]
        return list(text)

    def _has_arc(self, state_of: int, token: int, time: int) -> bool:
        """Whether the state behind one token has an arc for another, after the merge of that rank."""
        while True:
            at, until = state_of, time
            while True:
                removed = self.removes.get((at, token))
                if removed is not None and removed <= until:
                    return False
                if at not in self.born:
                    break
                until = min(until, self.born[at] - 1)
                at = self.right[at]
            if token not in self.born:
                return True
            token, time = self.left[token], self.born[token]

    def step(self, state: int, token: int) -> bool:
        """Whether the transition exists; read from the gadgets once."""
        if state == self.START:
            return True
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            known = self.arcs[state, token] = self._has_arc(state, token, len(self.label))
        return known

    def encode(self, symbols: list[str]) -> list[int]:
        """The tokens of the one path whose labels make up the symbols."""
        n = len(symbols)
        last, back = [self.START] * (n + 1), [0] * (n + 1)
        reached = [True] + [False] * n
        trie, token_at, step = self.trie, self.token_at, self.step
        for i in range(n):
            if not reached[i]:
                continue
            node, state = 0, last[i]
            for j in range(i, n):
                node = trie.get((node, symbols[j]))
                if node is None:
                    break
                token = token_at.get(node)
                if token is not None and step(state, token):
                    last[j + 1], back[j + 1], reached[j + 1] = token, i, True
        if not reached[n]:
            raise ValueError("a symbol is not in the vocabulary")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs."""
        return [self.label[i] for i in ids]


class Codec:
    """A tokenizers file of kind BPE with word ends, encoded and decoded by its merge automaton.

    The file's own normalizer and splitter are used for texts with characters from U+0300 on; below,
    lower case and the file's pattern give the same words.
    """

    def __init__(self, name: str = VOCABULARY):
        path = public_tokenizers.path(name)
        with open(path) as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.label |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.byte = _byte_symbols()
        self.of_symbol = {c: b for b, c in enumerate(self.byte)}
        self.cache: dict[str, tuple[str, str, int]] = {}

    def pieces(self, text: str) -> list[str]:
        if not _UNSETTLED.search(text):
            return self.find(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [bytes(self.of_symbol[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word_ids(self, word: str) -> list[int]:
        symbols = [self.byte[b] for b in word.encode()]
        symbols[-1] += self.end
        return self.automaton.encode(symbols)

    def _word(self, word: str) -> tuple[str, str, int]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids = self.word_ids(word)
        self.cache[word] = out = (" ".join(map(str, ids)), " ".join(self.automaton.decode(ids)), len(ids))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.forms(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.automaton.decode(ids))

    def forms(self, text: str | None) -> tuple[str, str, int]:
        """The ids joined by spaces, the decoded text, and the number of tokens."""
        found: list[tuple[str, str, int]] = []
        get, make = self.cache.get, self._word
        for part in self.split_special(text or ""):
            if part in self.special:
                found.append((str(self.special[part]), part, 1))
            elif part:
                found += [get(w) or make(w) for w in self.pieces(part)]
        if not found:
            return "", "", 0
        ids, decoded, counts = zip(*found, strict=True)
        return " ".join(ids), " ".join(decoded), sum(counts)


_codecs: dict[str, Codec] = {}


def codec(name: str = VOCABULARY) -> Codec:
    """One codec for each worker process."""
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


def _added(df: DataFrame, source: str, kind: pa.DataType, sql: str, target: str, work) -> DataFrame:
    arrow_limits(df.sparkSession)
    if target in df.columns:
        raise ValueError(f"the input already has a column {target}")
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([work(x) for x in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, target])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{target}` {sql}"])
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the token ids of each text. A null or empty text has none; other columns and repeated rows stay as they are."""
    return _added(df, text_col, pa.list_(pa.int32()), "array<int>", out_col, lambda t: codec(vocabulary).encode(t))


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text that the ids decode to, token labels joined by a space. Null ids give an empty text."""
    return _added(df, ids_col, pa.string(), "string", out_col, lambda ids: codec(vocabulary).decode(ids or []))


def roundtrip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes each text in one pass and returns digests of both; one row per input row."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            made = [c.forms(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "n_tokens": pa.array([m[2] for m in made], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(m[0].encode()).hexdigest() for m in made], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(m[1].encode()).hexdigest() for m in made], pa.string()),
                }
            )

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its tokens and the digests of its ids and of the text decoded from them. A null text is empty: no tokens. Repeated rows are rows of their own; a text of any length is encoded whole."""
    return roundtrip_digests(documents(spark, sf_dir))
