"""The dashboard: misplaced books by the order judgement, counted by photo, day and section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from .registry import registered, view

_FLAGS = f"""WITH wrong AS ({sequence.ORACLE["misplaced_books"]}), f AS (SELECT c.scan, c.band, c.pos, c.call, c.cls, c.how, CASE WHEN w.pos IS NULL THEN 0 ELSE 1 END AS mis, CASE WHEN w.pos IS NOT NULL AND c.supp % 3 = 0 THEN 1 ELSE 0 END AS resolved
    FROM confirmed c LEFT JOIN wrong w ON w.scan = c.scan AND w.band = c.band AND w.pos = c.pos)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, band, pos, call, cls, how, mis, resolved) of read books; only directly read ones are judged, and only against each other."""
    rows = view(spark, sf_dir, "SELECT scan, band, pos, call, cls, how, supp FROM confirmed")
    wrong = sequence.judged_books(spark, sf_dir).where("misplaced").select("scan", "band", "pos", F.lit(1).alias("mis"))
    rows = rows.join(wrong, ["scan", "band", "pos"], "left").withColumn("mis", F.coalesce("mis", F.lit(0)))
    return rows.withColumn("resolved", F.when((F.col("mis") == 1) & (F.col("supp") % 3 == 0), 1).otherwise(0)).drop("supp")


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT id AS scan, day, device FROM photos")


@registered(f"{_FLAGS} SELECT p.day, p.device, f.scan, f.pos, f.call FROM f JOIN photos p ON p.id = f.scan WHERE f.mis = 1")
def misplaced_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where("mis = 1").join(_photos(spark, sf_dir), "scan").select("day", "device", "scan", "pos", "call")


@registered(f"{_FLAGS} SELECT p.id, p.day, (SELECT cast(sum(mis) AS bigint) FROM f WHERE f.scan = p.id) AS mis FROM photos p")
def sessions_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo with its number of misplaced books; null if it has no read book."""
    sums = flags(spark, sf_dir).groupBy("scan").agg(F.sum("mis").alias("mis"))
    return _photos(spark, sf_dir).join(sums, "scan", "left").select(F.col("scan").alias("id"), "day", "mis")


@registered(f"{_FLAGS} SELECT count(DISTINCT scan) AS photos, count(*) AS books, cast(coalesce(sum(mis), 0) AS bigint) AS misplaced, cast(coalesce(sum(resolved), 0) AS bigint) AS resolved FROM f")
def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).agg(F.count_distinct("scan").alias("photos"), F.count("*").alias("books"), F.coalesce(F.sum("mis"), F.lit(0)).alias("misplaced"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"))


@registered(f"{_FLAGS} SELECT p.day, count(*) AS books, cast(sum(f.mis) AS bigint) AS misplaced FROM f JOIN photos p ON p.id = f.scan GROUP BY p.day")
def misplaced_count_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).join(_photos(spark, sf_dir), "scan").groupBy("day").agg(F.count("*").alias("books"), F.sum("mis").alias("misplaced"))


@registered(f"{_FLAGS} SELECT substr(cls, 1, 1) || '00' AS section, count(*) AS books, cast(sum(mis) AS bigint) AS misplaced FROM f GROUP BY 1")
def section_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).groupBy(F.concat(F.substring("cls", 1, 1), F.lit("00")).alias("section")).agg(F.count("*").alias("books"), F.sum("mis").alias("misplaced"))


@registered(f"{_FLAGS} SELECT scan, band, pos, call, mis FROM f WHERE how = 'direct'")
def direct_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where("how = 'direct'").select("scan", "band", "pos", "call", "mis")


@registered(
    """WITH s AS (SELECT conv_id, string_agg(coalesce(role, '') || ':' || cast(length(coalesce(text, '')) % 4 AS string), ',' ORDER BY turn) AS seq FROM conversations GROUP BY conv_id) SELECT min(conv_id) AS conv_id, seq, count(*) AS copies FROM s GROUP BY seq"""
)
def photo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each sequence of its rows, the first by number, with its copies."""
    item = F.concat_ws(":", F.coalesce("role", F.lit("")), (F.length(F.coalesce("text", F.lit(""))) % 4).cast("string"))
    rows = view(spark, sf_dir, "SELECT conv_id, turn, role, text FROM conversations").select("conv_id", F.struct("turn", item.alias("i")).alias("t"))
    seq = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["i"]), ",").alias("seq"))
    return seq.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))


def report_text(tables: dict[str, DataFrame], rows: int = 15) -> str:
    """A fixed-width report of small result tables, the first rows of each."""
    out = []
    for title, df in tables.items():
        held = [df.columns, *([str(v) for v in r] for r in df.limit(rows).collect())]
        width = [max(len(r[k]) for r in held) for k in range(len(df.columns))]
        out += [f"== {title} ==", *("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in held), ""]
    return "\n".join(out)


def report_html(tables: dict[str, DataFrame], rows: int = 50) -> str:
    """The same as an HTML page; values are escaped."""
    import html

    out = ["<!DOCTYPE html><meta charset='utf-8'><title>Shelf inspection</title>"]
    for title, df in tables.items():
        cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        body = "".join(f"<tr>{cells('td', r)}</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{html.escape(title)}</h2><table><tr>{cells('th', df.columns)}</tr>{body}</table>")
    return "\n".join(out)
