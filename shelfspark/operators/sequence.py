"""Order judgement: which items of a shelf row are out of place.

Rows of one band are put in physical order; those outside a longest non-decreasing subsequence of sort keys are
misplaced. Of several longest ones the result is fixed: the chain ends at the earliest place where the greatest
length is reached, and each predecessor is the earliest one that fits. A band holds as many books as a shelf
does, so a group is small; groups are spread by (scan, band).
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.text import sort_key
from ..plans.catalog import DUCK, SPARK, VIEWS


def kept_in_order(keys: list) -> list[bool]:
    """Which items belong to the longest non-decreasing subsequence described above. Nothing is kept of nothing."""
    lengths, ends = [], []
    for k in keys:
        n = bisect_right(ends, k)
        lengths.append(n + 1)
        ends[n : n + 1] = [k]
    kept = [False] * len(keys)
    if not keys:
        return kept
    at = lengths.index(max(lengths))
    while True:
        kept[at] = True
        if lengths[at] == 1:
            return kept
        at = next(j for j in range(at) if keys[j] <= keys[at] and lengths[j] == lengths[at] - 1)


def judge(rows: DataFrame, key: str = "key", group: tuple[str, ...] = ("scan", "band"), order: str = "pos") -> DataFrame:
    """Adds ``misplaced``; rows with a null key (unread) are not judged and get null. Bands go to Python as arrays, many to a batch."""
    bands = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*rows.columns).alias("row")))).alias("rows"))  # a band is a shelf's length

    @F.pandas_udf("array<boolean>")
    def outside(keys: pd.Series) -> pd.Series:
        return keys.map(judged)

    bands = bands.withColumn("out", outside(F.transform("rows", lambda r: r["row"][key])))
    return bands.select(F.explode(F.arrays_zip("rows", "out")).alias("x")).select("x.rows.row.*", F.col("x.out").alias("misplaced"))


def judged(keys) -> list[bool | None]:
    """Which keys are out of order; None for a null key."""
    known = [k is not None and k == k for k in keys]
    kept = iter(kept_in_order([k for k, ok in zip(keys, known, strict=True) if ok]))
    return [not next(kept) if ok else None for ok in known]


def assign(candidates: list[list[int]], uses: int = 2) -> int:
    """The greatest number of spines that can get one of their candidate numbers so that the numbers don't fall and none is used more than ``uses`` times."""
    best: dict[tuple[int, int], int] = {(-1, 0): 0}
    for options in candidates:
        new = dict(best)
        for (last, used), n in best.items():
            for v in options:
                state = (v, used + 1) if v == last else (v, 1)
                if (v > last or v == last and used < uses) and new.get(state, -1) < n + 1:
                    new[state] = n + 1
        best = new
    return max(best.values())


def _constant(value, kind: DataType) -> Column:
    """A collected value, structs and arrays included, as a column of its type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*(_constant(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return F.array(*(_constant(v, kind.elementType) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def _range_of(rows: DataFrame, keys: list[str], ranges: int = 64, per_range: int = 16) -> Column:
    """The number of a row's range of keys, of about ``ranges`` or as many as there are shuffle partitions, if they are fewer.

    Bounds are collected once, so a row has the same number in every branch and every run of a plan; ids of range
    partitions have not, their bounds are sampled and partitions merged for each exchange anew. Bounds decide only how
    even the ranges are.
    """
    n = max(2, min(ranges, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = rows.select(F.struct(*keys).alias("k")).orderBy(F.xxhash64("k")).limit(per_range * n)
    found = some.agg(F.sort_array(F.collect_list("k")).alias("k"))
    kind, key = found.schema["k"].dataType.elementType, F.struct(*keys)
    bounds = [_constant(b, kind) for b in found.first()["k"][per_range - 1 :: per_range]]

    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(key > bounds[middle], search(middle + 1, last)).otherwise(search(first, middle))

    return search(0, len(bounds))


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place`` (long, from 1) by the unique keys, without bringing all rows to one task.

    Rows are numbered within ranges of keys; the ranges' counts, one number each, shift them.
    """
    part = rows.withColumn("_part", _range_of(rows, keys)).repartitionByRange("_part")
    part = part.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)).cast("long"))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each range
    return part.join(shifts, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_n")


def ranked_keys(rows: DataFrame, run: int = 10_000) -> DataFrame:
    """(key, first, last): for each distinct key the first and last place of its rows in the order of keys, summed by runs of so many keys."""
    counts = placed(rows.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    part = counts.withColumn("_part", F.floor((F.col("place") - 1) / run))
    part = part.withColumn("_sum", F.sum("n").over(Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    totals = part.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("_before") + F.col("_sum")
    return part.join(F.broadcast(totals.select("_part", before.alias("_before"))), "_part").select("key", (last - F.col("n") + 1).alias("first"), last.alias("last"))


_KEYED = "SELECT s.scan, s.band, s.pos, s.call, cast(r.place AS bigint) AS key FROM spine s JOIN ranked r ON r.ord = s.ord WHERE s.how = 'direct'"


def _with_views(dialect, body: str, used: tuple[str, ...] = ("catalog", "spine", "ranked")) -> str:
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v](dialect)})" for v in used) + " " + body


def judged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, band, pos, call, key, misplaced) of directly read books, ``key`` being the sort key of their call and then the catalog's order."""
    for t in ("part", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    rows = spark.sql(_with_views(SPARK, "SELECT scan, band, pos, call, ord FROM spine WHERE how = 'direct'", ("catalog", "spine")))
    places = placed(spark.sql(_with_views(SPARK, "SELECT ord, call FROM catalog", ("catalog",))).withColumn("key", sort_key("call")), ["key", "ord"])
    return judge(rows.join(places.select("ord", F.col("place").alias("key")), "ord").drop("ord"))


def misplaced_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_books(spark, sf_dir).where("misplaced").select("scan", "band", "pos", "call")


def order_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest ordered run of each band."""
    judged = judged_books(spark, sf_dir)
    return judged.groupBy("scan", "band").agg(F.count("*").alias("books"), F.count_if(~F.col("misplaced")).alias("ordered"))


_CHAINS = """
, s AS ({keyed}), r AS (SELECT *, row_number() OVER (PARTITION BY scan, band ORDER BY pos) AS i FROM s),
c AS (SELECT scan, band, i, key, 1 AS n FROM r UNION SELECT r.scan, r.band, r.i, r.key, c.n + 1 FROM c JOIN r ON r.scan = c.scan AND r.band = c.band AND r.i > c.i AND r.key >= c.key),
l AS (SELECT scan, band, i, max(n) AS n FROM c GROUP BY scan, band, i)"""


def _oracle(tail: str) -> str:
    return _with_views(DUCK, "").replace("WITH ", "WITH RECURSIVE ", 1) + _CHAINS.format(keyed=_KEYED) + tail


QUERIES = {"misplaced_books": misplaced_books, "order_lengths": order_lengths}
ORACLE = {
    "order_lengths": _oracle(" SELECT scan, band, count(*) AS books, max(n) AS ordered FROM (SELECT scan, band, i, cast(n AS bigint) AS n FROM l) x GROUP BY scan, band"),
    "misplaced_books": _oracle("""
, p AS (SELECT a.scan, a.band, a.i, min(b.i) AS j FROM l a JOIN r x ON x.scan = a.scan AND x.band = a.band AND x.i = a.i JOIN l b ON b.scan = a.scan AND b.band = a.band AND b.i < a.i AND b.n = a.n - 1
        JOIN r y ON y.scan = b.scan AND y.band = b.band AND y.i = b.i AND y.key <= x.key GROUP BY a.scan, a.band, a.i),
k AS (SELECT l.scan, l.band, min(l.i) AS i FROM l JOIN (SELECT scan, band, max(n) AS n FROM l GROUP BY scan, band) m ON m.scan = l.scan AND m.band = l.band AND m.n = l.n GROUP BY l.scan, l.band
      UNION ALL SELECT p.scan, p.band, p.j FROM k JOIN p ON p.scan = k.scan AND p.band = k.band AND p.i = k.i)
SELECT r.scan, r.band, r.pos, r.call FROM r LEFT JOIN k ON k.scan = r.scan AND k.band = r.band AND k.i = r.i WHERE k.i IS NULL"""),
}
