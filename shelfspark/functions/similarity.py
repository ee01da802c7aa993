"""String similarities that Spark lacks, as Arrow-batched functions of two columns.

All are null if either argument is null. ``matching_ratio`` depends on the order of its arguments. The scores depend only on which
characters are equal, so those of short texts are named by their first places in the first text: few such pairs differ, and each is scored once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

SUBSTRING_WEIGHT = 0.6
MIN_SHORTER = 4
#: Names of the characters of short texts by place, and of those that the first text lacks.
_PLACES, _OTHER = "abcdefghijklmnopqrst", "-"


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters, by recursive longest matching blocks; 1.0 for two empty texts."""
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=100_000)
def common_run(a: str, b: str) -> int:
    """Length of the longest common substring."""
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def substring_share(a: str, b: str, least: int = 1) -> float:
    """The longest common substring as a share of the shorter text, which counts as ``least`` characters at least."""
    return common_run(a, b) / max(least, min(len(a), len(b)))


def blended(a: str, b: str, least: int = 1) -> float:
    return SUBSTRING_WEIGHT * substring_share(a, b, least) + (1 - SUBSTRING_WEIGHT) * ratio(a, b)


def _pairwise(score: Callable[[str, str], float]):
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    udf = F.pandas_udf(scores, DoubleType())

    def of(a: Column | str, b: Column | str) -> Column:
        x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
        short = (F.length(x) <= len(_PLACES)) & (F.length(y) <= len(_PLACES))
        places = F.concat(F.substring(F.lit(_PLACES), F.lit(1), F.length(x)), F.repeat(F.lit(_OTHER), F.length(y)))
        named = lambda c: F.when(short, F.call_function("translate", c, F.concat(x, y), places)).otherwise(c)
        return udf(named(x), named(y))

    return of


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


matching_ratio = _pairwise(ratio)
common_substring = _pairwise(substring_share)
blend = _pairwise(blended)
title_blend = _pairwise(lambda a, b: blended(a, b, MIN_SHORTER))
nfc = F.pandas_udf(_nfc, StringType())
