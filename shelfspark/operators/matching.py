"""Fuzzy matching of readings against the catalog inside blocks of one class.

Distinct (class, reading, candidate) triples are scored once and joined back, so the Python work grows
with different texts and not with rows. Ties go to the smaller candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import blend, matching_ratio, title_blend
from ..plans import catalog

ENOUGH, MARGIN = 0.75, 0.05
TITLE_ENOUGH, TITLE_SURE, TITLE_MARGIN = 0.55, 0.90, 0.10
SUGGEST_FROM, SUGGEST_TOP = 0.55, 3


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the bound shelf views."""
    return catalog.run(spark, sf_dir, sql)


def scored(reads: DataFrame, candidates: DataFrame, score: Column) -> DataFrame:
    """(cls, read, cand, score) for the distinct texts of each class; ``reads`` has (cls, read), ``candidates`` (cls, cand)."""
    pairs = reads.where("read <> ''").select("cls", "read").distinct().join(candidates.select("cls", "cand").distinct(), "cls")
    return pairs.withColumn("score", F.round(score, 6))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rn, the rank by falling score, and second, the score of the next candidate."""
    by = Window.partitionBy("cls", "read").orderBy(F.desc("score"), "cand")
    return scores.withColumns({"rn": F.row_number().over(by), "second": F.lead("score").over(by)})


def accepted(scores: DataFrame, enough: float, sure: float, margin: float) -> DataFrame:
    """The best candidate of each reading if its score is enough and, unless sure, the next one is a margin away."""
    best = ranked(scores).where("rn = 1")
    return best.where((F.col("score") >= enough) & ((F.col("score") >= sure) | (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin))).select("cls", "read", "cand", "score")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT scan, pos, cls, mark AS read FROM parsed")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT DISTINCT cls, author AS cand FROM calls")


def fuzzy_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's author mark by similarity, among the marks of its class."""
    reads = _readings(spark, sf_dir)
    best = accepted(scored(reads, _authors(spark, sf_dir), matching_ratio("read", "cand")), ENOUGH, 2.0, MARGIN)
    return reads.join(best, ["cls", "read"]).select("scan", "pos", "read", F.col("cand").alias("author"), "score")


def blended_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fuzzy_author``, by the blend of common substring and matching ratio, with a smaller threshold and a wider margin."""
    reads = _readings(spark, sf_dir)
    best = accepted(scored(reads, _authors(spark, sf_dir), blend("read", "cand")), 0.5, 2.0, 0.15)
    return reads.join(best, ["cls", "read"]).select("scan", "pos", "read", F.col("cand").alias("author"), "score")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three close author marks for each reading."""
    reads = _readings(spark, sf_dir)
    close = ranked(scored(reads, _authors(spark, sf_dir), matching_ratio("read", "cand")).where(F.col("score") >= SUGGEST_FROM)).where(F.col("rn") <= SUGGEST_TOP)
    return reads.join(close, ["cls", "read"]).select("scan", "pos", "read", F.col("cand").alias("author"), "score", "rn")


def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles read with losses (every fifth character missing) against the titles of their class, main title only."""
    reads = view(spark, sf_dir, "SELECT scan, pos, cls, regexp_replace(lower(split(title, ' : ')[0]), '([^ ]{4})[^ ]', '$1') AS read FROM spine WHERE how = 'title'")
    titles = view(spark, sf_dir, "SELECT DISTINCT cls, lower(split(title, ' : ')[0]) AS cand FROM catalog")
    best = accepted(scored(reads, titles, title_blend("read", "cand")), TITLE_ENOUGH, TITLE_SURE, TITLE_MARGIN)
    return reads.join(best, ["cls", "read"]).select("scan", "pos", "read", F.col("cand").alias("title"), "score")


QUERIES = {"fuzzy_author": fuzzy_author, "blended_author": blended_author, "author_suggestions": suggestions, "title_match": title_match}
