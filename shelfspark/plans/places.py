"""Registered queries over boxes, tokens and the order of rows on a shelf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import folds, sequence
from .registry import registered, view

# --- order judgement and assignment ----------------------------------------------------------

_CANDIDATES = "(SELECT scan, band, pos, ord % 50 AS a, (ord * 7 + pos) % 50 AS b, pos % 3 AS n, ord % 5 = 0 AS again FROM spine) x"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, f"SELECT * FROM {_CANDIDATES}")
    both = F.array(F.col("a").cast("int"), F.col("b").cast("int"))
    return rows.select("scan", "band", "pos", "again", F.array_distinct(F.slice(both, F.lit(1), F.col("n").cast("int"))).alias("candidates"))


_STATES = f"""RECURSIVE r AS (SELECT scan, band, a, b, n, again, row_number() OVER (PARTITION BY scan, band ORDER BY pos) AS i FROM {_CANDIDATES}),
    c AS (SELECT scan, band, i, again, a AS v FROM r WHERE n >= 1 UNION SELECT scan, band, i, again, b FROM r WHERE n = 2),
    s(scan, band, i, last, uses, got) AS (SELECT DISTINCT scan, band, 0, -1, 0, 0 FROM r
        UNION SELECT s.scan, s.band, c.i, c.v, CASE WHEN c.v = s.last THEN 2 ELSE 1 END, s.got + 1 FROM s JOIN c ON c.scan = s.scan AND c.band = s.band AND c.i > s.i AND (c.v > s.last OR (c.v = s.last AND s.uses = 1 AND AGAIN)))"""


@registered(f"WITH {_STATES.replace('AGAIN', 'true')} SELECT scan, band, max(got) AS assigned FROM s GROUP BY scan, band")
def assign_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spines of a band the global monotone assignment gives a number."""
    done = folds.assignment(_candidates(spark, sf_dir))
    return done.groupBy("scan", "band").agg(F.count("assigned").alias("assigned"))


@registered(f"WITH {_STATES.replace('AGAIN', 'c.again')} SELECT scan, band, max(got) AS assigned FROM s GROUP BY scan, band")
def assign_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a number again only on a spine with a copy mark."""
    done = folds.assignment(_candidates(spark, sf_dir), repeat="again")
    return done.groupBy("scan", "band").agg(F.count("assigned").alias("assigned"))


@registered()
def assign_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment with numbers that the catalog has (even ones here) and with any: ghosts are assigned numbers it lacks, suspects unassigned spines with candidates."""
    rows = _candidates(spark, sf_dir)
    real = lambda v: v % 2 == 0
    kinds = {"catalog": F.filter("candidates", real), "order only": F.col("candidates")}
    out = []
    for name, own in kinds.items():
        done = folds.assignment(rows.withColumn("candidates", own))
        got = F.col("assigned")
        out.append(done.agg(F.lit(name).alias("kind"), F.count(got).alias("assigned"), F.count_if(~real(got)).alias("ghosts"), F.count_if(got.isNull() & (F.size("candidates") > 0)).alias("suspects")))
    return out[0].union(out[1])


@registered()
def assign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each spine: assigned, by its title, or out of order."""
    done = folds.assignment(_candidates(spark, sf_dir)).withColumn("title_number", F.when(F.col("pos") % 4 == 0, (F.col("pos") * 11 % 50).cast("int")))
    return folds.assignment_status(done).select("scan", "band", "pos", "number", "how", "status")


@registered(
    """WITH d AS (SELECT scan, band, pos, ord FROM spine WHERE how = 'direct'), p AS (SELECT d.*, cast(o.place AS bigint) AS k FROM d JOIN (SELECT ord, rank() OVER (ORDER BY cls_num, author, vol, ord) AS place FROM catalog) o ON o.ord = d.ord),
    r AS (SELECT scan, band, max(k) AS hi, min(k) AS lo, count(*) AS books FROM p GROUP BY scan, band) SELECT scan, band, books, hi - lo AS spread FROM r"""
)
def band_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart in the catalog the directly read books of a band stand; places come from a range-partitioned sort."""
    rows = view(spark, sf_dir, "SELECT scan, band, ord FROM spine WHERE how = 'direct'")
    places = sequence.placed(view(spark, sf_dir, "SELECT ord, cls_num, author, vol FROM catalog"), ["cls_num", "author", "vol", "ord"])
    return rows.join(places.select("ord", "place"), "ord").groupBy("scan", "band").agg(F.count("*").alias("books"), (F.max("place") - F.min("place")).alias("spread"))


# --- rows, clusters, boxes -------------------------------------------------------------------

_BOXES = "(SELECT scan, pos, x0, y0, x1, y1, conf, call, flag, part FROM detections) x"


@registered(
    """WITH b AS (SELECT scan, pos, (y0 + y1) / 2 AS y, median(y1 - y0) OVER (PARTITION BY scan) AS h FROM detections), c AS (SELECT *, lag(y) OVER (PARTITION BY scan ORDER BY y, pos) AS before FROM b)
    SELECT a.scan, a.pos, count(*) AS band FROM c a JOIN c z ON z.scan = a.scan AND (z.before IS NULL OR z.y - z.before > 0.8 * z.h) AND (z.y < a.y OR (z.y = a.y AND z.pos <= a.pos)) GROUP BY a.scan, a.pos"""
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of boxes: a new one where the next centre is more than 0.8 median heights below, numbered from 1."""
    rows = view(spark, sf_dir, f"SELECT * FROM {_BOXES}").withColumns({"y": (F.col("y0") + F.col("y1")) / 2, "h": F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy("scan"))})
    w = Window.partitionBy("scan").orderBy("y", "pos")
    rows = rows.withColumn("new", F.when(F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(1e9)) > 0.8 * F.col("h"), 1).otherwise(0))
    return rows.select("scan", "pos", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("band"))


@registered(
    """WITH b AS (SELECT scan, pos, (x0 + x1) / 2 AS x, y0, x1 - x0 AS wide FROM detections), m AS (SELECT scan, median(wide) AS w FROM b GROUP BY scan), c AS (SELECT b.*, w, lag(x) OVER (PARTITION BY b.scan ORDER BY x, pos) AS before FROM b JOIN m ON m.scan = b.scan),
    k AS (SELECT a.scan, a.pos, a.x, a.y0, a.w, count(*) AS cluster FROM c a JOIN c z ON z.scan = a.scan AND (z.before IS NULL OR z.x - z.before > 0.7 * z.w) AND (z.x < a.x OR (z.x = a.x AND z.pos <= a.pos)) GROUP BY a.scan, a.pos, a.x, a.y0, a.w)
    SELECT scan, cluster, string_agg(cast(pos AS string), ',' ORDER BY floor(y0 / 30 + 0.5), x, pos) AS reading, round(min(x) - 0.4 * min(w), 6) AS x0, round(max(x) + 0.4 * min(w), 6) AS x1 FROM k GROUP BY scan, cluster"""
)
def x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of tokens by gaps of 0.7 median widths, in reading order (rows of 30, then x), with a padded box."""
    rows = view(spark, sf_dir, f"SELECT * FROM {_BOXES}").withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "w": F.median(F.col("x1") - F.col("x0")).over(Window.partitionBy("scan"))})
    w = Window.partitionBy("scan").orderBy("x", "pos")
    rows = rows.withColumn("new", F.when(F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(1e9)) > 0.7 * F.col("w"), 1).otherwise(0))
    rows = rows.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.sort_array(F.collect_list(F.struct(F.floor(F.col("y0") / 30 + 0.5).alias("row"), "x", "pos")))
    out = rows.groupBy("scan", "cluster").agg(order.alias("o"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("w").alias("w"))
    return out.select("scan", "cluster", F.array_join(F.transform("o", lambda i: i["pos"].cast("string")), ",").alias("reading"), F.round(F.col("lo") - 0.4 * F.col("w"), 6).alias("x0"), F.round(F.col("hi") + 0.4 * F.col("w"), 6).alias("x1"))


@registered()
def running_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of boxes by running centres, taken in the order of y in heights and then x."""
    rows = view(spark, sf_dir, f"SELECT scan, pos, x0, (y0 + y1) / 2 AS y, y1 - y0 AS h FROM {_BOXES}").withColumn("step", F.floor(F.col("y") / F.greatest(F.col("h"), F.lit(1.0)) + 0.5))
    return folds.folded(rows, ["scan"], ["step", "x0", "pos"], ["y", "h"], folds.row_groups, "int", "row").select("scan", "pos", "row")


@registered(
    f"""WITH RECURSIVE o AS (SELECT scan, x0, y0, x1, y1, row_number() OVER (PARTITION BY scan ORDER BY x0 + x1, x0, y0, x1, y1, pos) AS i FROM {_BOXES}),
    m AS (SELECT scan, i, x0, y0, x1, y1, 1 AS k FROM o WHERE i = 1 UNION ALL
        SELECT m.scan, o.i, CASE WHEN j THEN least(m.x0, o.x0) ELSE o.x0 END, CASE WHEN j THEN least(m.y0, o.y0) ELSE o.y0 END, CASE WHEN j THEN greatest(m.x1, o.x1) ELSE o.x1 END, CASE WHEN j THEN greatest(m.y1, o.y1) ELSE o.y1 END, CASE WHEN j THEN m.k ELSE m.k + 1 END
        FROM m JOIN o ON o.scan = m.scan AND o.i = m.i + 1, LATERAL (SELECT greatest(0, least(m.x1, o.x1) - greatest(m.x0, o.x0)) / least(m.x1 - m.x0, o.x1 - o.x0) > 0.55 AS j) t)
    SELECT scan, k, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY scan, k ORDER BY i DESC) AS rn FROM m) z WHERE rn = 1"""
)
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from left to right, united where they share more than 0.55 of the narrower width with the one before."""

    def merge(items: list[tuple]) -> list[tuple]:
        return [(k + 1, *b) for k, b in enumerate(folds.overlap_merge([i[1:5] for i in items]))]

    rows = view(spark, sf_dir, f"SELECT *, x0 + x1 AS c FROM {_BOXES}")
    return folds.folded_rows(rows, ["scan"], ["c", "x0", "y0", "x1", "y1", "pos"], merge, "k bigint, x0 double, y0 double, x1 double, y1 double")


@registered(
    f"""WITH RECURSIVE o AS (SELECT scan, pos, x0, coalesce(call, '') AS call, conf, row_number() OVER (PARTITION BY scan ORDER BY x0, pos) AS i FROM {_BOXES}),
    m AS (SELECT scan, i, pos, x0, call, conf, 1 AS k FROM o WHERE i = 1 UNION ALL
        SELECT m.scan, o.i, CASE WHEN j AND o.conf <= m.conf THEN m.pos ELSE o.pos END, CASE WHEN j AND o.conf <= m.conf THEN m.x0 ELSE o.x0 END, o.call, CASE WHEN j AND o.conf <= m.conf THEN m.conf ELSE o.conf END, CASE WHEN j THEN m.k ELSE m.k + 1 END
        FROM m JOIN o ON o.scan = m.scan AND o.i = m.i + 1, LATERAL (SELECT o.call <> '' AND o.call = m.call AND abs(o.x0 - m.x0) < 130 AS j) t)
    SELECT scan, pos FROM (SELECT *, row_number() OVER (PARTITION BY scan, k ORDER BY i DESC) AS rn FROM m) z WHERE rn = 1"""
)
def without_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from left to right without the weaker of two neighbours with one call."""
    rows = view(spark, sf_dir, f"SELECT scan, pos, x0, call, conf FROM {_BOXES}")
    return folds.folded(rows, ["scan"], ["x0", "pos"], ["x0", "call", "conf"], folds.adjacent_kept, "boolean", "kept").where("kept").select("scan", "pos")


@registered(
    f"""WITH RECURSIVE o AS (SELECT scan, call, pos, x0, x1 - x0 AS w, conf, row_number() OVER (PARTITION BY scan, call ORDER BY pos) AS i FROM {_BOXES} WHERE call IS NOT NULL),
    m AS (SELECT scan, call, i, pos, x0, conf, cast(NULL AS bigint) AS lost FROM o WHERE i = 1 UNION ALL
        SELECT m.scan, m.call, o.i, CASE WHEN n AND o.conf < m.conf THEN m.pos ELSE o.pos END, CASE WHEN n AND o.conf < m.conf THEN m.x0 ELSE o.x0 END, CASE WHEN n AND o.conf < m.conf THEN m.conf ELSE o.conf END, CASE WHEN NOT n THEN NULL WHEN o.conf < m.conf THEN o.pos ELSE m.pos END
        FROM m JOIN o ON o.scan = m.scan AND o.call = m.call AND o.i = m.i + 1, LATERAL (SELECT abs(m.x0 - o.x0) < 2 * o.w AS n) t)
    SELECT b.scan, b.pos, CASE WHEN l.lost IS NULL THEN b.call END AS call FROM {_BOXES.replace(") x", ") b")} LEFT JOIN (SELECT DISTINCT scan, lost FROM m WHERE lost IS NOT NULL) l ON l.scan = b.scan AND l.lost = b.pos"""
)
def near_duplicates_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in their order; of two with one call within two widths the weaker loses it."""
    rows = view(spark, sf_dir, f"SELECT scan, pos, x0, x1 - x0 AS w, call, conf FROM {_BOXES}")
    out = folds.folded(rows, ["scan"], ["pos"], ["x0", "w", "call", "conf"], folds.near_duplicates_cleared, "boolean", "keeps")
    return out.select("scan", "pos", F.when(F.col("keeps"), F.col("call")).alias("call"))


@registered(
    f"""WITH RECURSIVE g AS (SELECT scan, pos, x0 + part % 9 AS x0, y0, x1 + part % 9 AS x1, y1, row_number() OVER (PARTITION BY scan ORDER BY pos) AS k FROM {_BOXES}),
    d AS (SELECT scan, pos, x0, y0, x1, y1, row_number() OVER (PARTITION BY scan ORDER BY conf DESC, pos) AS i FROM {_BOXES} WHERE flag <> 'R'),
    v AS (SELECT d.scan, d.i, d.pos, g.pos AS truth, a / ((d.x1 - d.x0) * (d.y1 - d.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) - a) AS iou FROM d JOIN g ON g.scan = d.scan,
        LATERAL (SELECT greatest(0, least(d.x1, g.x1) - greatest(d.x0, g.x0)) * greatest(0, least(d.y1, g.y1) - greatest(d.y0, g.y0)) AS a) t),
    m(scan, i, used, hit, who) AS (SELECT DISTINCT scan, 0, cast([] AS bigint[]), cast(NULL AS bigint), cast(NULL AS bigint) FROM d UNION ALL
        SELECT m.scan, m.i + 1, CASE WHEN b.iou >= 0.5 THEN list_append(m.used, b.truth) ELSE m.used END, CASE WHEN b.iou >= 0.5 THEN b.truth END, b.pos
        FROM m JOIN d ON d.scan = m.scan AND d.i = m.i + 1, LATERAL (SELECT d.pos, max(v.iou) AS iou, arg_max(v.truth, (v.iou, -v.truth)) AS truth FROM v WHERE v.scan = d.scan AND v.i = d.i AND NOT list_contains(m.used, v.truth)) b)
    SELECT scan, who AS pos, hit AS truth FROM m WHERE who IS NOT NULL"""
)
def greedy_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, best first, with the unused true box that overlaps most, at 0.5; without one a detection is false."""
    found = view(spark, sf_dir, f"SELECT scan, pos, conf, struct(x0, y0, x1, y1) AS box FROM {_BOXES} WHERE flag <> 'R'").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct(-F.col("conf"), "pos", "box"))).alias("found"))
    truth = view(spark, sf_dir, f"SELECT scan, pos, struct(x0 + part % 9 AS x0, y0, x1 + part % 9 AS x1, y1) AS box FROM {_BOXES}").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("pos", "box"))).alias("truth"))

    @F.pandas_udf("array<int>")
    def hits(a, b):
        import pandas as pd

        boxes = lambda rows: [tuple(r[k] for k in ("x0", "y0", "x1", "y1")) for r in rows]
        return pd.Series([folds.greedy_matches(boxes(x), boxes(y)) for x, y in zip(a, b, strict=True)])

    both = found.join(truth, "scan").withColumn("hit", hits(F.transform("found", lambda f: f["box"]), F.transform("truth", lambda t: t["box"])))
    out = both.select("scan", "truth", F.explode(F.arrays_zip(F.transform("found", lambda f: f["pos"]).alias("pos"), "hit")).alias("r"))
    return out.select("scan", "r.pos", F.get("truth", F.col("r.hit"))["pos"].alias("truth"))


@registered(
    f"""WITH RECURSIVE u AS (SELECT scan, pos, x0, y0, x1, y1 FROM {_BOXES} WHERE call IS NULL AND NOT EXISTS (SELECT 1 FROM detections r WHERE r.scan = x.scan AND r.call IS NOT NULL AND r.pos % 5 <> 0 AND least(r.x1, x.x1) > greatest(r.x0, x.x0) AND least(r.y1, x.y1) > greatest(r.y0, x.y0)) AND pos % 5 <> 0),
    e AS (SELECT a.scan, a.pos AS a, b.pos AS b FROM u a JOIN u b ON b.scan = a.scan AND least(b.x1, a.x1) > greatest(b.x0, a.x0) AND least(b.y1, a.y1) > greatest(b.y0, a.y0)),
    w AS (SELECT scan, a, b FROM e UNION SELECT w.scan, w.a, e.b FROM w JOIN e ON e.scan = w.scan AND e.a = w.b)
    SELECT s.scan, count(DISTINCT l.first) AS books FROM (SELECT DISTINCT scan FROM detections) s LEFT JOIN (SELECT scan, a, min(b) AS first FROM w GROUP BY scan, a) l ON l.scan = s.scan GROUP BY s.scan"""
)
def unread_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many books the unread boxes stand for; every fifth row has no box and is passed over."""
    rows = view(spark, sf_dir, f"SELECT scan, pos, call, CASE WHEN pos % 5 <> 0 THEN struct(x0, y0, x1, y1) END AS box FROM {_BOXES}")
    items = rows.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("pos", "call", "box"))).alias("i"))

    @F.pandas_udf("bigint")
    def books(call, box):
        import pandas as pd

        corners = lambda b: None if b is None else (b["x0"], b["y0"], b["x1"], b["y1"])
        return pd.Series([folds.connected_unread(list(c), [corners(b) for b in own]) for c, own in zip(call, box, strict=True)])

    return items.select("scan", books(F.transform("i", lambda i: i["call"]), F.transform("i", lambda i: i["box"])).alias("books"))


@registered(
    f"""WITH s AS (SELECT scan, pos, x0, x1, coalesce(x0 > lag(x1) OVER (PARTITION BY scan ORDER BY x0, x1, pos) + 12, true) AS new FROM {_BOXES} WHERE flag = 'N') SELECT scan, min(x0) AS x0, arg_max(x1, (x0, x1, pos)) AS x1, count(*) AS runs
    FROM (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY scan ORDER BY x0, x1, pos) AS g FROM s) z GROUP BY scan, g"""
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs joined where the gap to the run before is at most 12; a joined run ends where its last one does."""
    w = Window.partitionBy("scan").orderBy("x0", "x1", "pos")
    rows = view(spark, sf_dir, f"SELECT scan, pos, x0, x1 FROM {_BOXES} WHERE flag = 'N'")
    rows = rows.withColumn("new", F.when(F.col("x0") - F.lag("x1").over(w) <= 12, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("scan", "g").agg(F.min("x0").alias("x0"), F.max_by("x1", F.struct("x0", "x1", "pos")).alias("x1"), F.count("*").alias("runs")).drop("g")


# --- joins in space --------------------------------------------------------------------------

_TOKENS = "(SELECT scan, pos AS token, (x0 + x1) / 2 + part % 31 - 15 AS x, (y0 + y1) / 2 AS y, part FROM detections) t"


@registered(
    f"""SELECT t.scan, t.token, arg_min(d.pos, (round(abs((d.x0 + d.x1) / 2 - t.x), 6), d.pos)) AS nearest, coalesce(min(d.pos) FILTER (WHERE t.x BETWEEN d.x0 AND d.x1), arg_min(d.pos, (round(abs((d.x0 + d.x1) / 2 - t.x), 6), d.pos))) AS spine,
        min(d.pos) FILTER (WHERE t.x > d.x0 - 3 AND t.x <= d.x1 + 3 AND t.y BETWEEN d.y0 - 6 AND d.y1 + 6) AS box FROM {_TOKENS} JOIN detections d ON d.scan = t.scan GROUP BY t.scan, t.token"""
)
def token_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each token the box with the nearest centre, the first spine whose interval holds it (else the nearest), and the first padded box around it."""
    tokens = view(spark, sf_dir, f"SELECT * FROM {_TOKENS}")
    both = tokens.join(view(spark, sf_dir, "SELECT scan, pos, x0, y0, x1, y1 FROM detections"), "scan")
    far = F.round(F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("x")), 6)
    inside = F.col("x").between(F.col("x0"), F.col("x1"))
    padded = (F.col("x") > F.col("x0") - 3) & (F.col("x") <= F.col("x1") + 3) & F.col("y").between(F.col("y0") - 6, F.col("y1") + 6)
    out = both.groupBy("scan", "token").agg(F.min_by("pos", F.struct(far, "pos")).alias("nearest"), F.min(F.when(inside, F.col("pos"))).alias("first"), F.min(F.when(padded, F.col("pos"))).alias("box"))
    return out.select("scan", "token", "nearest", F.coalesce("first", "nearest").alias("spine"), "box")


@registered(
    f"""WITH n AS (SELECT t.scan, t.token, d.pos, abs((d.x0 + d.x1) / 2 - t.x) AS far, d.x1 - d.x0 AS w, row_number() OVER (PARTITION BY t.scan, t.token ORDER BY abs((d.x0 + d.x1) / 2 - t.x), d.pos) AS rn FROM {_TOKENS} JOIN detections d ON d.scan = t.scan AND d.flag <> 'R')
    SELECT scan, token, pos FROM n WHERE rn = 1 AND far <= greatest(60, 0.9 * w)"""
)
def token_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to the box with the nearest centre, the first of equal ones, at most 60 or 0.9 widths away; boxes of status R were not found."""
    both = view(spark, sf_dir, f"SELECT * FROM {_TOKENS}").join(view(spark, sf_dir, "SELECT scan, pos, x0, x1 FROM detections WHERE flag <> 'R'"), "scan")
    both = both.withColumns({"far": F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("x")), "w": F.col("x1") - F.col("x0")})
    near = both.groupBy("scan", "token").agg(F.min_by(F.struct("pos", "far", "w"), F.struct("far", "pos")).alias("n"))
    return near.where("n.far <= greatest(60, 0.9 * n.w)").select("scan", "token", "n.pos")


@registered(
    """WITH m AS (SELECT scan, median(x1 - x0) AS w FROM detections GROUP BY scan) SELECT a.scan, a.pos AS a, b.pos AS b FROM detections a JOIN detections b ON b.scan = a.scan AND a.flag = 'A' AND b.flag = 'N' JOIN m ON m.scan = a.scan
    WHERE abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) < 0.6 * w AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < 1.2 * w"""
)
def corresponding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two detectors whose centres lie within 0.6 median widths in x and twice that in y."""
    rows = view(spark, sf_dir, "SELECT scan, pos, flag, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, median(x1 - x0) OVER (PARTITION BY scan) AS w FROM detections")
    a, b = (rows.where(F.col("flag") == f).select("scan", F.col("pos").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("w").alias(f"{c}w")) for f, c in (("A", "a"), ("N", "b")))
    return a.join(b, "scan").where((F.abs(F.col("ax") - F.col("bx")) < 0.6 * F.col("aw")) & (F.abs(F.col("ay") - F.col("by")) < 1.2 * F.col("aw"))).select("scan", "a", "b")


@registered(
    """WITH m AS (SELECT scan, median(x1 - x0) AS w FROM detections GROUP BY scan), o AS (SELECT d.scan, d.pos, d.x0, d.part, coalesce(d.x0 - lag(d.x0) OVER (PARTITION BY d.scan ORDER BY d.x0, d.pos) > 0.7 * m.w, true) AS new FROM detections d JOIN m ON m.scan = d.scan),
    c AS (SELECT scan, part FROM o WHERE new), b AS (SELECT scan, part FROM detections WHERE flag = 'A') SELECT scan, part AS book, 'box' AS channel FROM b UNION ALL SELECT DISTINCT scan, part, 'cluster' FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.scan = c.scan AND b.part = c.part)"""
)
def cluster_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by their boxes' tokens and, beside them, by clusters of all tokens: a cluster adds a call that no box gave."""
    calls = view(spark, sf_dir, "SELECT scan, pos, x0, x1, part, flag FROM detections")
    by_box = calls.where("flag = 'A'").select("scan", F.col("part").alias("book"), F.lit("box").alias("channel"))
    w = Window.partitionBy("scan").orderBy("x0", "pos")
    wide = F.median(F.col("x1") - F.col("x0")).over(Window.partitionBy("scan"))
    rows = calls.withColumn("w", wide).withColumn("new", F.when(F.col("x0") - F.lag("x0").over(w) <= 0.7 * F.col("w"), 0).otherwise(1))
    rows = rows.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_cluster = rows.groupBy("scan", "cluster").agg(F.min_by("part", F.struct("x0", "pos")).alias("book")).select("scan", "book", F.lit("cluster").alias("channel"))
    extra = by_cluster.join(by_box.select("scan", "book").distinct(), ["scan", "book"], "left_anti").dropDuplicates(["scan", "book"])
    return by_box.union(extra)


@registered()
def resplit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token clusters cut again where class numbers or number anchors stand apart, and the anchors that no cluster is near."""
    import re

    rows = view(spark, sf_dir, "SELECT scan, (x0 + x1) / 2 AS x, y0 AS y, CASE pos % 3 WHEN 0 THEN lpad(cast(part % 1000 AS string), 3, '0') WHEN 1 THEN '가' || cast(part % 90 + 10 AS string) ELSE '' END AS t, pos FROM detections")

    def cut(items: list[tuple]) -> list[tuple]:
        tokens = [(x, y, t) for x, y, t, _ in items if t]
        digits = [x for x, _, t, _ in items if not t]
        clusters = folds.resplit(tokens, 30, lambda t: re.fullmatch("[0-9]{3}([.][0-9]+)?", t) is not None, lambda t: re.search("[가-힣][0-9]{1,3}", t) is not None)
        clusters = [p for c in clusters for p in folds.split_at(c, digits)]
        out = [(k, min(t[0] for t in c), " ".join(t[2] for t in sorted(c, key=lambda t: (t[1], t[0])))) for k, c in enumerate(clusters)]
        ghosts = folds.ghost_slots(digits, [(min(t[0] for t in c) + max(t[0] for t in c)) / 2 for c in clusters], 60)
        return out + [(-1, x, "") for x in ghosts]

    return folds.folded_rows(rows, ["scan"], ["x", "y", "t", "pos"], cut, "cluster bigint, x double, tokens string")


@registered()
def aligned_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a close reading and a wide one of the same shelf, paired between their common books."""
    rows = view(spark, sf_dir, "SELECT l_suppkey AS shelf, l_orderkey % 2 AS side, l_orderkey * 10 + l_linenumber AS o, cast(l_partkey % 1000 AS double) AS x, CASE WHEN l_returnflag <> 'R' THEN cast(l_partkey AS string) END AS call FROM lineitem")

    def pair(items: list[tuple]) -> list[tuple]:
        return folds.aligned(*([(call, x) for x, _, side, call in items if side == s] for s in (0, 1)))

    return folds.folded_rows(rows, ["shelf"], ["x", "o", "side", "call"], pair, "truth int, target int")


# --- inference -------------------------------------------------------------------------------

_WALK = "(SELECT substr(cls, 1, 2) AS scan, 0 AS band, row_number() OVER (PARTITION BY substr(cls, 1, 2) ORDER BY cls_num, author, vol, ord) AS pos, ord FROM catalog WHERE status = 'shelf') x"


@registered(
    f"""WITH k AS (SELECT ord, call, cls_num, (author, 0) AS a FROM catalog), n AS (SELECT scan, band, pos, ord, lag(ord) OVER w AS l, lead(ord) OVER w AS r, count(*) OVER (PARTITION BY scan, band) AS n FROM {_WALK} WINDOW w AS (PARTITION BY scan, band ORDER BY pos)),
    t AS (SELECT n.scan, n.band, n.pos, m.call, least((x.cls_num, x.a), (y.cls_num, y.a)) AS lo, greatest((x.cls_num, x.a), (y.cls_num, y.a)) AS hi, (m.cls_num, m.a) AS own FROM n JOIN k x ON x.ord = n.l JOIN k y ON y.ord = n.r JOIN k m ON m.ord = n.ord WHERE n.n >= 3),
    g AS (SELECT * FROM t WHERE lo < own AND own < hi) SELECT g.scan, g.band, g.pos, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(c.call) = min(g.call) END AS hit FROM g JOIN k c ON (c.cls_num, c.a) > g.lo AND (c.cls_num, c.a) < g.hi GROUP BY g.scan, g.band, g.pos HAVING count(*) <= 6"""
)
def loo_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one out: the catalog rows strictly between the keys of both neighbours, where the row's own key lies there too; with one candidate whether it is the row.

    Keys leave the volume out, so volumes of one work are candidates each. Only gaps of up to six candidates are listed.
    """
    keys = view(spark, sf_dir, "SELECT ord, call FROM catalog").withColumn("key", text.inference_key("call"))
    ranks = sequence.ranked_keys(keys.select("key")).select("key", "first", "last")  # distinct keys with the places of their rows
    books = keys.join(ranks, "key").select("ord", "call", F.col("first").alias("k_first"), F.col("last").alias("k_last"))
    w = Window.partitionBy("scan", "band").orderBy("pos")
    walk = view(spark, sf_dir, f"SELECT * FROM {_WALK}").join(books, "ord")
    walk = walk.withColumns({"lf": F.lag("k_first").over(w), "ll": F.lag("k_last").over(w), "rf": F.lead("k_first").over(w), "rl": F.lead("k_last").over(w), "n": F.count("*").over(Window.partitionBy("scan", "band"))})
    after, before = F.least("ll", "rl"), F.greatest("lf", "rf")  # last place of the lower key, first place of the upper one
    gate = (F.col("n") >= 3) & (F.col("k_first") > after) & (F.col("k_last") < before)
    open_ = walk.where(gate).select("scan", "band", "pos", "call", (before - after - 1).alias("candidates"), (after + 1).alias("only"))
    one = sequence.placed(keys.select("ord", "call", "key"), ["key", "ord"]).select(F.col("place").alias("only"), F.col("call").alias("guess"))
    named = open_.where("candidates <= 6").join(one, "only", "left")
    return named.select("scan", "band", "pos", "candidates", F.when(F.col("candidates") == 1, F.col("guess") == F.col("call")).alias("hit"))


@registered(
    """WITH p AS (SELECT ord, cls, rank() OVER (ORDER BY cls_num, substr(author, 1, 1), cutter, tail, vol, ord) AS place FROM catalog), n AS (SELECT scan, band, pos, ord, lag(ord) OVER (PARTITION BY scan, band ORDER BY pos) AS l FROM spine WHERE how <> 'none')
    SELECT n.scan, n.band, n.pos, a.place - b.place AS step, CASE WHEN substr(a.cls, 1, 1) <> substr(b.cls, 1, 1) THEN 'section ' || substr(a.cls, 1, 1) || '00' WHEN a.place > b.place THEN 'right' WHEN a.place < b.place THEN 'left' ELSE 'here' END AS direction FROM n JOIN p a ON a.ord = n.ord JOIN p b ON b.ord = n.l"""
)
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places right or left of the book before a book belongs; another section is named instead."""
    places = sequence.placed(view(spark, sf_dir, "SELECT ord, call, cls FROM catalog").withColumn("key", text.sort_key("call")), ["key", "ord"]).select("ord", "cls", "place")
    w = Window.partitionBy("scan", "band").orderBy("pos")
    rows = view(spark, sf_dir, "SELECT scan, band, pos, ord FROM spine WHERE how <> 'none'").join(places, "ord")
    rows = rows.withColumns({"b": F.lag("place").over(w), "b_cls": F.lag("cls").over(w)}).where("b is not null")
    section = F.substring("cls", 1, 1)
    direction = F.when(section != F.substring("b_cls", 1, 1), F.concat(F.lit("section "), section, F.lit("00"))).when(F.col("place") > F.col("b"), "right").when(F.col("place") < F.col("b"), "left").otherwise("here")
    return rows.select("scan", "band", "pos", (F.col("place") - F.col("b")).alias("step"), direction.alias("direction"))


def reasons(rows: DataFrame) -> DataFrame:
    """Judged rows (scan, band, pos, call, key, misplaced): for misplaced ones the neighbours on the shelf and those in order between which they belong."""
    w = Window.partitionBy("scan", "band").orderBy("pos")
    rows = rows.withColumns({"left_call": F.lag("call").over(w), "right_call": F.lead("call").over(w)})
    kept = rows.where("not misplaced").select("scan", "band", F.col("key").alias("k"), F.col("pos").alias("p"), F.col("call").alias("c"))
    wrong = rows.where("misplaced").select("scan", "band", "pos", "call", "key", "left_call", "right_call")
    near = wrong.join(kept, ["scan", "band"], "left")
    out = near.groupBy("scan", "band", "pos", "call", "left_call", "right_call").agg(F.max_by("c", F.struct(F.when(F.col("k") <= F.col("key"), F.col("k")).alias("k"), F.when(F.col("k") <= F.col("key"), F.col("p")).alias("p"))).alias("after"), F.count_if(F.col("k") <= F.col("key")).alias("n"), F.min_by("c", F.when(F.col("k") > F.col("key"), F.struct("k", "p"))).alias("before"))
    return out.select("scan", "band", "pos", "call", "left_call", "right_call", F.when(F.col("n") > 0, F.col("after")).alias("belongs_after"), F.col("before").alias("belongs_before"))


@registered(
    f"""WITH wrong AS ({sequence.ORACLE["misplaced_books"]}), d AS (SELECT s.scan, s.band, s.pos, s.call, cast(r.place AS bigint) AS k, lag(s.call) OVER w AS l, lead(s.call) OVER w AS n FROM spine s JOIN ranked r ON r.ord = s.ord WHERE s.how = 'direct' WINDOW w AS (PARTITION BY s.scan, s.band ORDER BY s.pos)),
    f AS (SELECT d.* FROM d ANTI JOIN wrong USING (scan, band, pos)) SELECT x.scan, x.band, x.pos, x.call, x.l AS left_call, x.n AS right_call, arg_max(f.call, (f.k, f.pos)) FILTER (WHERE f.k <= x.k) AS belongs_after, arg_min(f.call, (f.k, f.pos)) FILTER (WHERE f.k > x.k) AS belongs_before
    FROM d x JOIN wrong w ON w.scan = x.scan AND w.band = x.band AND w.pos = x.pos LEFT JOIN f ON f.scan = x.scan AND f.band = x.band GROUP BY x.scan, x.band, x.pos, x.call, x.l, x.n"""
)
def reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(sequence.judged_books(spark, sf_dir))


def find_chances(rows: DataFrame) -> DataFrame:
    """Rows (scan, band, pos, call, place) of one shelf walk, place null where unread, and a target place: where the wanted book may stand.

    Read exactly: 98. Between two read books that enclose it one unread gap: 95, two: 45 each. Otherwise a direction.
    """
    w = Window.partitionBy("scan", "band").orderBy("pos")
    known = F.col("place").isNotNull()
    before = F.last("place", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("place", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after, "run": F.sum(F.when(known, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    gap = F.count("*").over(Window.partitionBy("scan", "band", "run")) - F.when(F.col("run") > 0, 1).otherwise(0)
    rows = rows.withColumn("gaps", gap)
    encloses = ~known & (F.col("before") < F.col("target")) & (F.col("target") < F.col("after"))
    chance = F.when(known & (F.col("place") == F.col("target")), 98).when(encloses & (F.col("gaps") == 1), 95).when(encloses & (F.col("gaps") == 2), 45)
    return rows.withColumn("chance", chance)


@registered(
    """WITH p AS (SELECT ord, rank() OVER (ORDER BY cls_num, substr(author, 1, 1), cutter, tail, vol, ord) AS place FROM catalog), s AS (SELECT s.scan, s.band, s.pos, s.how, p.place, avg(p.place) OVER (PARTITION BY s.scan, s.band) AS m FROM spine s JOIN p ON p.ord = s.ord),
    t AS (SELECT scan, band, arg_min(place, (abs(place - m), place)) AS target FROM s GROUP BY scan, band), r AS (SELECT s.scan, s.band, s.pos, CASE WHEN s.how <> 'none' THEN s.place END AS place, t.target FROM s JOIN t ON t.scan = s.scan AND t.band = s.band),
    u AS (SELECT r.*, (SELECT max(k.pos) FROM r k WHERE k.scan = r.scan AND k.band = r.band AND k.pos < r.pos AND k.place IS NOT NULL) AS lp, (SELECT min(k.pos) FROM r k WHERE k.scan = r.scan AND k.band = r.band AND k.pos > r.pos AND k.place IS NOT NULL) AS rp FROM r),
    v AS (SELECT u.*, a.place AS lo, b.place AS hi, (SELECT count(*) FROM r k WHERE k.scan = u.scan AND k.band = u.band AND k.pos > u.lp AND k.pos < u.rp) AS n FROM u LEFT JOIN r a ON a.scan = u.scan AND a.band = u.band AND a.pos = u.lp LEFT JOIN r b ON b.scan = u.scan AND b.band = u.band AND b.pos = u.rp)
    SELECT scan, band, pos, CASE WHEN place = target THEN 98 WHEN place IS NULL AND lo < target AND target < hi THEN CASE n WHEN 1 THEN 95 WHEN 2 THEN 45 END END AS chance FROM v WHERE place = target OR (place IS NULL AND lo < target AND target < hi AND n <= 2)"""
)
def find_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the middle book of each band where a reader may find it, by ``find_chances``."""
    places = sequence.placed(view(spark, sf_dir, "SELECT ord, call FROM catalog").withColumn("key", text.sort_key("call")), ["key", "ord"]).select("ord", "place")
    rows = view(spark, sf_dir, "SELECT scan, band, pos, ord, how FROM spine").join(places, "ord")
    rows = rows.withColumn("m", F.avg("place").over(Window.partitionBy("scan", "band")))
    target = F.min_by("place", F.struct(F.abs(F.col("place") - F.col("m")), "place")).over(Window.partitionBy("scan", "band"))
    rows = rows.withColumn("target", target).withColumn("place", F.when(F.col("how") != "none", F.col("place")))
    return find_chances(rows).where("chance is not null").select("scan", "band", "pos", "chance")
