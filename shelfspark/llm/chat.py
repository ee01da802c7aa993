"""Chat formatting: records of many layouts to canonical turns, and turns to one marked-up text.

A record's *fingerprint* is a hash of the sorted set of its nested field paths (``messages[].role``),
whatever the values. Each mapping declares the paths of its layout, optional ones included, and how
they become turns; the fingerprints of all its variants select it. So the layout of a record is found
by one lookup and adding a layout is adding a declaration.

The template marks turns as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. Control
strings inside roles and texts are broken up by an escape that is undone exactly on reading.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_limits

# Strings that chat templates of common models give a meaning.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
START, END = CONTROL[0], CONTROL[1]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CODE = {"<": "l", "[": "b"}
_BACK = {"l": "<", "b": "[", "n": "\n", "\\": "\\"}


@dataclass(frozen=True)
class Mapping:
    """``turns`` is a list of ("list", path, role field, text field) or ("field", role, path), in order."""

    name: str
    required: tuple[str, ...]
    turns: tuple[tuple[str, ...], ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def variants(self) -> Iterator[frozenset[str]]:
        for k in range(len(self.optional) + 1):
            for extra in combinations(self.optional, k):
                yield frozenset({*self.required, *extra})


_COMMON_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_ID = ("id", "conv_id", "source")
MAPPINGS = (
    Mapping("messages", ("messages", "messages[]", "messages[].role", "messages[].content"), (("list", "messages", "role", "content"),), _ID),
    Mapping("empty messages", ("messages",), (("list", "messages", "role", "content"),), _ID),
    Mapping("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), (("list", "conversations", "from", "value"),), (*_ID, "system"), _COMMON_ROLES),
    Mapping("prompt and completion", ("prompt", "completion"), (("field", "user", "prompt"), ("field", "assistant", "completion")), _ID),
    Mapping("prompt and response", ("prompt", "response"), (("field", "system", "system"), ("field", "user", "prompt"), ("field", "assistant", "response")), (*_ID, "system")),
    Mapping("question and answer", ("question", "answer"), (("field", "user", "question"), ("field", "assistant", "answer")), _ID),
    Mapping("instruction", ("instruction", "output"), (("field", "system", "system"), ("field", "user", "instruction", "input"), ("field", "assistant", "output")), (*_ID, "system", "input")),
)


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; elements of a list share one path."""
    found: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            own = f"{at}.{k}" if at else k
            found |= {own} | paths(v, own)
    elif isinstance(value, list):
        for v in value:
            found |= {f"{at}[]"} | paths(v, f"{at}[]")
    return found


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(v): m for m in reversed(MAPPINGS) for v in m.variants()}


def canonical(record: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
    """A record's layout and its turns (role, text); (None, None) if no mapping knows its layout or a value is no text.

    A null text or role is empty. Any JSON has a result, however deep it is.
    """
    try:
        value = json.loads(record) if record else None
        mapping = REGISTRY.get(fingerprint(paths(value))) if isinstance(value, dict) else None
        turns = None if mapping is None else _turns(mapping, value)
    except (ValueError, RecursionError):
        return None, None
    return (None, None) if turns is None else (mapping.name, turns)


def _turns(mapping: Mapping, value: dict) -> list[tuple[str, str]] | None:
    """The turns that a mapping finds; None if what stands at its paths is not what it declares."""
    turns: list[tuple[str, str]] = []
    if mapping.name == "conversations" and value.get("system"):
        turns.append(("system", value["system"]))
    for kind, *spec in mapping.turns:
        if kind == "list":
            at, role, text = spec
            items = value[at] if value[at] is not None else []
            if not isinstance(items, list) or not all(isinstance(m, dict) and role in m and text in m for m in items):
                return None
            turns += [(mapping.roles.get(m[role], m[role]) if isinstance(m[role], str) else m[role], m[text]) for m in items]
        elif spec[1] in value:
            role, *fields = spec
            parts = [value[f] for f in fields if value.get(f) is not None]
            if not all(isinstance(p, str) for p in parts):
                return None
            if role != "system" or any(parts):
                turns.append((role, "\n\n".join(p for p in parts if p)))
    turns = [("" if role is None else role, "" if text is None else text) for role, text in turns]
    if not all(isinstance(x, str) for t in turns for x in t):
        return None
    "".join(x for t in turns for x in t).encode()  # half a surrogate pair is no text
    return turns


def escape(text: str) -> str:
    """Backslashes doubled, and the first character of each control string replaced by a backslash and a letter."""
    return _CONTROL.sub(lambda m: "\\" + _CODE[m[0][0]] + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it (code points) that the loss counts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition("\n")
        if not rest.endswith(f"{END}\n"):
            raise ValueError("a turn has no end")
        turns.append((unescape(head), unescape(rest[: -len(END) - 1])))
    return turns


FORMATTED = "conv_id long, layout string, formatted string, loss_spans array<struct<first:int,last:int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def format_records(df: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Formats JSON records of any known layout. A null, broken or unknown record gets a null layout and text, and no spans."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layouts, texts, spans = [], [], []
            for record in b.column(1).to_pylist():
                layout, turns = canonical(record)
                text, own = (None, []) if turns is None else render(turns)
                layouts.append(layout)
                texts.append(text)
                spans.append([{"first": x, "last": y} for x, y in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], names=["conv_id", "layout", "formatted", "loss_spans"])

    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string")).mapInArrow(run, FORMATTED)


def records(turns: DataFrame) -> DataFrame:
    """(conv_id, record) with the turns of each conversation, ordered by turn, as a record of the layout that fits it.

    A user's and an assistant's turn make a prompt and a response, with a system text before them a system field too;
    other conversations of these three roles make ``conversations`` if their number of turns is odd, all others
    ``messages``. Rows with equal turn numbers are ordered by role and text, repeated rows stay, nulls become empty.
    A conversation is one record, so its rows meet in one task; they are counted in turns, not documents.
    """
    message = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("content"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    roles = F.array_join(F.transform("m", lambda x: x["role"]), "\n")
    content = lambda k: F.get("m", F.lit(k))["content"]
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    named = F.transform("m", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["content"].alias("value")))
    known = F.forall("m", lambda x: x["role"].isin("user", "assistant", "system"))
    as_json = lambda *fields: F.to_json(F.struct("conv_id", *fields), {"ignoreNullFields": "false"})
    record = (
        F.when(roles == "user\nassistant", as_json(content(0).alias("prompt"), content(1).alias("response")))
        .when((roles == "system\nuser\nassistant") & (content(0) != ""), as_json(content(0).alias("system"), content(1).alias("instruction"), content(2).alias("output")))
        .when(known & (F.size("m") % 2 == 1), as_json(named.alias("conversations")))
        .otherwise(as_json(plain.alias("messages")))
    )
    return grouped.select("conv_id", record.alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in formatted texts: turns, text under the loss mask, and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text or "")
                loss = "".join(unescape(text[s["first"] : s["last"]]) for s in spans or ())
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text or "")))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, and for conversation -1, what is read back from its formatted text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return digests(format_records(records(turns.unionByName(own))))
