"""Normal forms of call numbers and titles, and sort keys of call numbers, as columns."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .similarity import nfc

SYLLABLES, CONSONANTS, VOWELS = "가-힣", "ㄱ-ㅎ", "ㅏ-ㅣ"

# The last character of an author mark as it is misread, and the consonant that is meant.
JAMO_REPAIR = {
    "0": "ㅇ", "O": "ㅇ", "o": "ㅇ", "Q": "ㅇ", "으": "ㅇ", "이": "ㅇ",
    "피": "ㅍ", "디": "ㄷ", "기": "ㄱ", "니": "ㄴ", "리": "ㄹ", "미": "ㅁ",
    "비": "ㅂ", "시": "ㅅ", "지": "ㅈ", "치": "ㅊ", "키": "ㅋ", "티": "ㅌ", "히": "ㅎ",
    "프": "ㅍ", "표": "ㅍ", "드": "ㄷ", "그": "ㄱ", "느": "ㄴ", "르": "ㄹ", "므": "ㅁ",
    "브": "ㅂ", "스": "ㅅ", "즈": "ㅈ", "츠": "ㅊ", "크": "ㅋ", "트": "ㅌ", "흐": "ㅎ",
}

# The initial consonants in the order of their syllables.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"

VOLUME = "[vV][.]?([0-9]+)"
#: A class number, an author mark and a volume, loosely: the last two may be missing.
LOOSE_CALL = f"([0-9]{{1,3}}(?:[.][0-9]+)?)[\\s-]*([{SYLLABLES}{CONSONANTS}{VOWELS}][{SYLLABLES}{CONSONANTS}{VOWELS}0-9]{{0,8}})?(?:[\\s-]*[vV][.]?\\s*([0-9]+))?"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def norm(text: Column | str) -> Column:
    """NFC, without white space, hyphens, dashes, underscores, slashes, middle dots and dots, lower case."""
    return F.lower(F.regexp_replace(nfc(_col(text)), "[\\s\\u2013\\u2014_/\\u00b7.-]+", ""))


def norm_title(text: Column | str) -> Column:
    """NFC, lower case, only digits, ASCII letters and Hangul syllables."""
    return F.regexp_replace(F.lower(nfc(_col(text))), f"[^0-9a-z{SYLLABLES}]", "")


def mark_text(text: Column | str) -> Column:
    """NFC, only digits, ASCII letters, Hangul syllables and jamo, and dots; a null is empty."""
    return F.regexp_replace(nfc(F.coalesce(_col(text), F.lit(""))), f"[^0-9A-Za-z{SYLLABLES}{CONSONANTS}{VOWELS}.]", "")


def mark_text_without_jamo(text: Column | str) -> Column:
    return F.regexp_replace(nfc(_col(text)), f"[^0-9A-Za-z{SYLLABLES}.]", "")


def plain_text(text: Column | str) -> Column:
    """NFC, only digits, ASCII letters and Hangul syllables, lower case: the form of token matching."""
    return F.lower(F.regexp_replace(nfc(_col(text)), f"[^0-9A-Za-z{SYLLABLES}]", ""))


def nfc_without_spaces(text: Column | str) -> Column:
    return F.regexp_replace(nfc(_col(text)), "\\s", "")


def without_copy(call: Column | str) -> Column:
    """A call number without its copy suffix ``=N``, ``c.N`` or ``C.N``."""
    return F.regexp_replace(F.trim(_col(call)), "\\s*(?:=|[cC][.])[0-9]+$", "")


def class_of(part: Column | str) -> Column:
    """The class number of a call number's first part: without a prefix of syllables or capitals if only digits and dots follow, else as it is."""
    part = F.trim(_col(part))
    digits = F.regexp_extract(part, f"^[{SYLLABLES}A-Z]*([0-9.]+)$", 1)
    return F.when(digits != "", digits).otherwise(part)


def tokens(call: Column | str) -> Column:
    """The parts of a call number between white space, hyphens, dashes, underscores and slashes, in plain form; the last is the volume."""
    parts = F.split(nfc(_col(call)), "[\\s\\u2013\\u2014_/-]+")
    return F.filter(F.transform(parts, lambda p: F.lower(F.regexp_replace(p, f"[^0-9A-Za-z{SYLLABLES}]", ""))), lambda p: p != "")


def loose_call(text: Column | str) -> Column:
    """struct(cls double, author, volume int) of the first call number in a text; null if there is none."""
    text = nfc(_col(text))
    part = lambda k: F.regexp_extract(text, LOOSE_CALL, k)
    volume = F.coalesce(F.when(part(3) != "", part(3)).try_cast("int"), F.lit(0))
    return F.when(part(1) != "", F.struct(part(1).try_cast("double").alias("cls"), part(2).alias("author"), volume.alias("volume")))


def variants(mark: Column) -> Column:
    """A mark and, if its last character is a known misreading, the mark as it is meant."""
    repair = F.create_map(*(F.lit(x) for pair in JAMO_REPAIR.items() for x in pair))
    meant = repair[F.substring(mark, -1, 1)]
    return F.when(meant.isNull(), F.array(mark)).otherwise(F.array(mark, F.concat(F.substring(mark, F.lit(1), F.length(mark) - 1), meant)))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_text(page: Column | str, limit: int = 400, entities: dict[str, str] | None = None) -> Column:
    """Plain text of an HTML snippet: entities, then tags to spaces, white space collapsed, the first ``limit`` characters.

    With ``entities`` only these count, in their order and as they are spelt, and of white space blanks, tabs and line ends;
    without it all of HTML's, also those without a semicolon.
    """
    if entities is None:
        raw, blank = unescaped(_col(page)), "[\\s\\u00a0]+"
    else:
        raw, blank = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(entities[e])), entities, _col(page)), "[ \\t\\n\\r]+"
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), blank, " ")), 1, limit)


# --- sort keys -------------------------------------------------------------------------------


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_key(c: Column) -> Column:
    """struct(a, b, c): a syllable by initial, medial + 1 and final, a bare initial before its syllables, others by code point + 100."""
    code = F.ascii(c)
    at = code - 0xAC00
    syllable = F.struct(F.floor(at / 588).cast("int").alias("a"), (F.floor((at % 588) / 28) + 1).cast("int").alias("b"), (at % 28).cast("int").alias("c"))
    bare = F.call_function("position", c, F.lit(INITIALS))
    other = lambda first: F.struct(first.cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    return F.when(code.between(0xAC00, 0xD7A3), syllable).when(bare > 0, other(bare - 1)).otherwise(other(code + 100))


def author_key(mark: Column) -> Column:
    """struct(head, cutter, tail): leading syllables and capitals by ``char_key``, the digits as a decimal fraction, the rest by ``char_key``."""
    head = F.regexp_extract(mark, f"^([{SYLLABLES}A-Z]+)([0-9]*)(.*)$", 1)
    digits = F.regexp_extract(mark, f"^([{SYLLABLES}A-Z]+)([0-9]*)(.*)$", 2)
    tail = F.regexp_extract(mark, f"^([{SYLLABLES}A-Z]+)([0-9]*)(.*)$", 3)
    whole = head == ""
    cutter = F.coalesce(F.concat(F.lit("0."), F.when(digits != "", digits)).try_cast("double"), F.lit(0.0))
    keys = lambda text: F.transform(_chars(text), char_key)
    return F.struct(keys(F.when(whole, mark).otherwise(head)).alias("head"), F.when(whole, 0.0).otherwise(cutter).alias("cutter"), keys(F.when(whole, "").otherwise(tail)).alias("tail"))


def sort_key(call: Column | str) -> Column:
    """struct(cls, author, volume) by which call numbers stand on a shelf.

    The class is a number, 999 if it isn't one; the author's key is empty without a second part; the volume is the first
    number of the third part, else 0. Structs and arrays compare element by element, a prefix first.
    """
    parts = F.split(_col(call), "-")
    cls = F.regexp_replace(F.get(parts, 0), f"^[{SYLLABLES}A-Z]+", "")
    number = F.coalesce(F.when(cls.rlike("^[0-9.]+$"), cls).try_cast("double"), F.lit(999.0))
    volume = F.regexp_extract(F.coalesce(F.get(parts, 2), F.lit("")), "[0-9]+", 0)
    return F.struct(number.alias("cls"), author_key(mark_text(F.get(parts, 1))).alias("author"), F.coalesce(F.when(volume != "", volume).try_cast("int"), F.lit(0)).alias("volume"))


def runs_key(call: Column | str) -> Column:
    """The older key: class, the author's runs with numbers as integers before letters, volume."""
    parsed = loose_call(call)
    runs = F.regexp_extract_all(parsed["author"], F.lit("([0-9]+|[^0-9])"), F.lit(1))
    one = F.transform(runs, lambda r: F.struct(F.when(r.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.when(r.rlike("^[0-9]+$"), r).try_cast("long"), F.lit(0)).alias("number"), F.when(r.rlike("^[0-9]+$"), "").otherwise(r).alias("letter")))
    return F.struct(parsed["cls"].alias("cls"), one.alias("author"), parsed["volume"].alias("volume"))


def raw_key(call: Column | str) -> Column:
    """The baseline key: class and the author mark as text."""
    parts = F.split(_col(call), "-")
    return F.struct(F.coalesce(F.regexp_extract(F.get(parts, 0), "[0-9]+(?:[.][0-9]+)?", 0).try_cast("double"), F.lit(999.0)).alias("cls"), F.coalesce(F.get(parts, 1), F.lit("")).alias("author"))


def inference_key(call: Column | str) -> Column:
    """The key of neighbour inference, without the volume: bare initials before their syllables, then digits one by one, then others; null without a class."""
    parts = F.split(nfc(_col(call)), "-")
    cls = F.regexp_extract(F.get(parts, 0), "^[0-9]+(?:[.][0-9]+)?", 0)

    def one(c: Column) -> Column:
        code, bare = F.ascii(c), F.call_function("position", c, F.lit(INITIALS))
        at = code - 0xAC00
        triple = lambda a, b, d: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), d.cast("int").alias("c"))
        syllable = triple(F.floor(at / 588), F.floor((at % 588) / 28), at % 28)
        return F.when(code.between(0xAC00, 0xD7A3), syllable).when(bare > 0, triple(bare - 1, F.lit(-1), F.lit(-1))).when(c.rlike("^[0-9]$"), triple(F.lit(100), code - 48, F.lit(0))).otherwise(triple(F.lit(200), code, F.lit(0)))

    return F.when(cls != "", F.struct(cls.try_cast("double").alias("cls"), F.transform(_chars(F.coalesce(F.get(parts, 1), F.lit(""))), one).alias("author")))
