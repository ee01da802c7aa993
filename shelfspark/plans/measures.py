"""Registered queries that count, grade, split and sample, and gates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import matching_ratio
from ..operators import sequence
from .registry import registered, view

# --- gates -----------------------------------------------------------------------------------


@registered(
    """SELECT scan, line, ord, supp, CASE WHEN conf < 0.35 OR NOT regexp_matches(read, '[0-9]') THEN 'unreadable' ELSE 'readable' END AS gate, regexp_matches(read, '[0-9]') OR length(regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g')) >= 2 AS plausible
        FROM (SELECT scan, line, ord, supp, read, CASE WHEN ord % 3 = 0 THEN '' ELSE title END AS title, (ord % 20) / 20 AS conf FROM asked) x WHERE conf >= 0.25"""
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of at least 0.25; unreadable below 0.35 or without a call number; a label is plausible with a digit or two characters of title."""
    rows = view(spark, sf_dir, "SELECT scan, line, ord, supp, read, CASE WHEN ord % 3 = 0 THEN '' ELSE title END AS title, (ord % 20) / 20 AS conf FROM asked").where("conf >= 0.25")
    unreadable = (F.col("conf") < 0.35) | text.loose_call("read").isNull()
    return rows.select("scan", "line", "ord", "supp", F.when(unreadable, "unreadable").otherwise("readable").alias("gate"), (F.col("read").rlike("[0-9]") | (F.length(text.norm_title("title")) >= 2)).alias("plausible"))


GATES = {"label": (0.60, 0.95, 0.08), "title": (0.55, 0.90, 0.10), "author": (0.75, 2.0, 0.05), "author_v2": (0.5, 2.0, 0.15), "retro": (0.75, 2.0, 0.1)}


@registered(
    """WITH s AS (SELECT scan, round(1 - jitter * 10, 4) AS score, pos FROM spine), t AS (SELECT scan, list_sort(list(score), 'DESC') AS l FROM s GROUP BY scan)
    SELECT scan, g.kind, l[1] >= g.enough AND (l[1] >= g.sure OR round(l[1] - coalesce(l[2], 0), 4) >= g.margin) AS accepted FROM t, (VALUES ('label', 0.60, 0.95, 0.08), ('title', 0.55, 0.90, 0.10), ('author', 0.75, 2.0, 0.05), ('author_v2', 0.5, 2.0, 0.15), ('retro', 0.75, 2.0, 0.1)) g(kind, enough, sure, margin)"""
)
def ambiguity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best score of a scan is accepted, by each of the five pairs of threshold and margin."""
    rows = view(spark, sf_dir, "SELECT scan, round(1 - jitter * 10, 4) AS score FROM spine").groupBy("scan").agg(F.sort_array(F.collect_list("score"), asc=False).alias("l"))
    top, second = F.get("l", F.lit(0)), F.coalesce(F.get("l", F.lit(1)), F.lit(0.0))
    kinds = [F.struct(F.lit(k).alias("kind"), ((top >= e) & ((top >= s) | (F.round(top - second, 4) >= m))).alias("accepted")) for k, (e, s, m) in GATES.items()]
    return rows.select("scan", F.explode(F.array(*kinds)).alias("k")).select("scan", "k.*")


@registered(
    """SELECT d.scan, d.pos FROM detections d JOIN photos p ON p.id = d.scan JOIN (SELECT scan, count(*) AS n FROM detections GROUP BY scan) c ON c.scan = d.scan
    WHERE p.device NOT LIKE '%NOT SPECIFIED%' AND d.y1 - d.y0 >= 40 AND d.conf >= 0.2 AND c.n >= 5"""
)
def usable_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of known devices that are tall and sharp enough, from photos with at least five boxes."""
    rows = view(spark, sf_dir, "SELECT d.scan, d.pos, d.y1 - d.y0 AS height, d.conf AS sharp, p.device FROM detections d JOIN photos p ON p.id = d.scan")
    rows = rows.withColumn("boxes", F.count("*").over(Window.partitionBy("scan")))
    return rows.where(~F.col("device").contains("NOT SPECIFIED") & (F.col("height") >= 40) & (F.col("sharp") >= 0.2) & (F.col("boxes") >= 5)).select("scan", "pos")


@registered(
    """SELECT scan, n, CASE WHEN rate >= 0.6 THEN 'truth' WHEN rate < 0.5 AND n >= 3 THEN 'target' ELSE 'other' END AS kind FROM (SELECT scan, count(*) AS n, count(*) FILTER (WHERE how = 'direct') / count(*) AS rate FROM spine GROUP BY scan) x"""
)
def frame_class(spark: SparkSession, sf_dir: str, slots: int = 3) -> DataFrame:
    """Frames with enough direct reads are truth, wide ones with few are targets; 30 slots are asked for on real shelves, three here."""
    rate = F.avg(F.when(F.col("how") == "direct", 1.0).otherwise(0.0))
    frames = view(spark, sf_dir, "SELECT scan, how FROM spine").groupBy("scan").agg(F.count("*").alias("n"), rate.alias("rate"))
    return frames.select("scan", "n", F.when(F.col("rate") >= 0.6, "truth").when((F.col("rate") < 0.5) & (F.col("n") >= slots), "target").otherwise("other").alias("kind"))


@registered()
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read on a crop with the part of its call that they show: similar enough, and no digits for syllables or the other way round."""
    rows = view(spark, sf_dir, "SELECT scan, line, ord, supp, read, truth FROM asked").select("scan", "line", "ord", "supp", F.explode(F.split("read", " ")).alias("read"), "truth")
    rows = rows.where((F.length("read") >= 2) & ~F.col("read").rlike("^[vcVC][.]?[0-9]"))
    parts = F.filter(F.transform(F.slice(F.split("truth", "-"), 1, 2), lambda p: F.split(p, "=")[0]), lambda p: F.length(p) >= 2)
    pairs = rows.select("read", F.explode(parts).alias("part")).distinct().withColumn("s", matching_ratio("read", "part"))
    best = rows.withColumn("part", F.explode(parts)).join(pairs, ["read", "part"]).groupBy("scan", "line", "ord", "supp", "read").agg(F.max_by(F.struct("part", "s"), F.struct("s", "part")).alias("b"))
    best = best.select("scan", "line", "ord", "supp", "read", "b.part", "b.s")
    digits = F.length(F.regexp_replace("read", "[^0-9]", "")) / F.length("read")
    bad = ((F.length("read") < 3) & (F.col("s") < 0.6)) | (F.col("part").rlike("[가-힣]") & (digits > 0.7)) | (F.col("part").rlike("^[0-9].*[.]") & ~F.col("read").contains(".") & (F.col("s") < 0.7))
    return best.where((F.col("s") >= 0.35) & ~bad).withColumn("s", F.round("s", 6))


# --- joins -----------------------------------------------------------------------------------


@registered("SELECT c.call, p.title, p.loans, p.place FROM (SELECT isbn13, title, loans, rank() OVER (ORDER BY loans DESC, isbn13) AS place FROM popular) p JOIN holdings c ON c.isbn13 = p.isbn13 WHERE p.place <= 357")
def popular_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned books among the 357 most borrowed, with title, loans and place."""
    top = view(spark, sf_dir, "SELECT isbn13, title, loans FROM popular").orderBy(F.desc("loans"), "isbn13").limit(357)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("loans"), "isbn13")))
    return view(spark, sf_dir, "SELECT isbn13, call FROM holdings").join(F.broadcast(top), "isbn13").select("call", "title", "loans", "place")


@registered("SELECT norm, call FROM (SELECT lower(regexp_replace(call, '[^0-9A-Za-z가-힣]', '', 'g')) AS norm, call, row_number() OVER (PARTITION BY lower(regexp_replace(call, '[^0-9A-Za-z가-힣]', '', 'g')) ORDER BY ord) AS rn FROM holdings) x WHERE rn = 1")
def first_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first catalog row of each plain form."""
    return view(spark, sf_dir, "SELECT ord, call FROM holdings").groupBy(text.plain_text("call").alias("norm")).agg(F.min_by("call", "ord").alias("call"))


@registered("SELECT call FROM calls EXCEPT SELECT call FROM spine WHERE how = 'direct' AND score >= 0.99 AND jitter < 0.01")
def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the catalog that no sharp and sure reading shows."""
    return view(spark, sf_dir, "SELECT call FROM calls").join(view(spark, sf_dir, "SELECT call FROM spine WHERE how = 'direct' AND score >= 0.99 AND jitter < 0.01"), "call", "left_anti")


_SERIES = "(SELECT cls || '-' || substr(mark, 1, 1) || CASE WHEN ord % 2 = 0 THEN 'ㄱ' || cast(vol AS string) ELSE '' END AS call FROM holdings) x"


@registered("SELECT a.ord, a.call, b.call AS like_call FROM holdings a JOIN holdings b ON substr(a.mark, 1, 2) = substr(b.mark, 1, 2) AND a.cls <> b.cls AND (starts_with(a.cls, b.cls) OR starts_with(b.cls, a.cls)) AND a.ord <> b.ord")
def risky_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of one author (the first two characters of the mark here) whose classes are prefixes of each other, which readers confuse."""
    rows = view(spark, sf_dir, "SELECT ord, call, cls, substr(mark, 1, 2) AS mark FROM holdings")
    other = rows.select(F.col("ord").alias("o"), F.col("call").alias("like_call"), F.col("cls").alias("o_cls"), "mark")
    # A prefix of a class starts with the same three digits, so that and the author are joined on.
    pairs = rows.withColumn("k", F.substring("cls", 1, 3)).join(other.withColumn("k", F.substring("o_cls", 1, 3)), ["k", "mark"])
    return pairs.where((F.col("cls") != F.col("o_cls")) & (F.startswith("cls", "o_cls") | F.startswith("o_cls", "cls"))).select("ord", "call", "like_call")


@registered(
    f"""WITH s AS (SELECT call, regexp_replace(call, '[0-9]+$', '') AS stem, regexp_matches(call, '[0-9]+$') AS tail FROM {_SERIES}) SELECT stem, count(*) AS members, min(call) AS first FROM s WHERE tail GROUP BY stem HAVING count(*) >= 2"""
)
def risk_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of calls that differ in a number at the end."""
    stem = F.regexp_extract("call", "^(.*?)[0-9]+$", 1)
    return view(spark, sf_dir, f"SELECT call FROM {_SERIES}").where(F.col("call").rlike("[0-9]$")).groupBy(stem.alias("stem")).agg(F.count("*").alias("members"), F.min("call").alias("first")).where("members >= 2")


# --- grades ----------------------------------------------------------------------------------


@registered(
    """WITH s AS (SELECT video, call FROM votes GROUP BY video, call HAVING count(DISTINCT frame) >= 2), t AS (SELECT DISTINCT call FROM votes WHERE value > 10), k AS (SELECT cast(video AS string) AS video, call FROM s UNION ALL SELECT DISTINCT 'all', call FROM s)
    SELECT video, round((SELECT count(*) FROM t WHERE t.call IN (SELECT call FROM k j WHERE j.video = k.video)) / greatest(1, (SELECT count(*) FROM t)), 6) AS read_rate, round(count(*) FILTER (WHERE call IN (SELECT call FROM t)) / greatest(1, count(*)), 6) AS confirm_rate FROM k GROUP BY video"""
)
def read_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the true books the share seen in two frames, and of those seen the share that is true; for each video and all together."""
    votes = view(spark, sf_dir, "SELECT video, frame, call, value FROM votes")
    stable = votes.groupBy(F.col("video").cast("string").alias("video"), "call").agg(F.count_distinct("frame").alias("n")).where("n >= 2").drop("n")
    truth = votes.where("value > 10").select("call").distinct().withColumn("true", F.lit(1))
    both = stable.union(stable.select(F.lit("all"), "call").distinct())
    graded = both.join(truth, "call", "left").groupBy("video").agg(F.count("true").alias("hits"), F.count("*").alias("seen"))
    total = F.broadcast(truth.agg(F.count("*").alias("total")))
    return graded.join(total).select("video", F.round(F.col("hits") / F.greatest(F.lit(1), "total"), 6).alias("read_rate"), F.round(F.col("hits") / F.greatest(F.lit(1), "seen"), 6).alias("confirm_rate"))


@registered(
    """WITH h AS (SELECT substr(c.cls, 1, 1) AS section, count(*) FILTER (WHERE p.loans > 700) * 25 / count(*) AS expected FROM holdings c LEFT JOIN popular p ON p.isbn13 = c.isbn13 GROUP BY 1) SELECT count(*) AS sections, count(*) FILTER (WHERE expected >= 0.5) AS enough, count(*) FILTER (WHERE expected >= 0.5) >= 5 AS passes FROM h"""
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least five sections promise half a hit in a shot of 25 books."""
    hits = view(spark, sf_dir, "SELECT c.cls, p.loans FROM holdings c LEFT JOIN popular p ON p.isbn13 = c.isbn13").groupBy(F.substring("cls", 1, 1).alias("section")).agg((F.count_if(F.col("loans") > 700) * 25 / F.count("*")).alias("expected"))
    enough = F.count_if(F.col("expected") >= 0.5)
    return hits.agg(F.count("*").alias("sections"), enough.alias("enough"), (enough >= 5).alias("passes"))


@registered(
    """WITH s AS (SELECT how, score >= 0.95 AS a, jitter >= 0.04 AS b FROM spine), g AS (SELECT how, count(*) AS n, sum(a::int) AS a, sum(b::int) AS b, sum((a <> b)::int) AS diff FROM s GROUP BY how)
    SELECT how, n, cast(a AS bigint) AS a, cast(b AS bigint) AS b, cast(diff AS bigint) AS diff, (SELECT bool_and(o.b >= o.a) FROM g o WHERE o.how <> g.how) AND g.b > g.a AS adopt FROM g"""
)
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers of two models by group and where they differ; a group adopts the new one if it gains and no other group loses."""
    rows = view(spark, sf_dir, "SELECT how, score >= 0.95 AS a, jitter >= 0.04 AS b FROM spine")
    groups = rows.groupBy("how").agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count_if(F.col("a") != F.col("b")).alias("diff"))
    losers = F.count_if(F.col("b") < F.col("a")).over(Window.partitionBy())  # a row for each group
    return groups.withColumn("losers", losers).withColumn("adopt", (F.col("losers") == 0) & (F.col("b") > F.col("a"))).drop("losers")


@registered(
    """SELECT flag AS domain, 'model ' || m AS model, sum(hit::int)::bigint AS hits, round(sum(hit::int) / count(*) FILTER (WHERE truth), 6) AS recall, (count(*) FILTER (WHERE found AND NOT truth))::bigint AS extra
        FROM (SELECT flag, m, pos % 3 <> 0 AS truth, conf >= 0.1 * m AS found, pos % 3 <> 0 AND conf >= 0.1 * m AS hit FROM detections, (VALUES (3), (6)) v(m)) x GROUP BY flag, m HAVING count(*) FILTER (WHERE truth) > 0"""
)
def detector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and extra boxes of two detectors on each domain."""
    rows = view(spark, sf_dir, "SELECT flag, pos, conf FROM detections").select(F.col("flag").alias("domain"), (F.col("pos") % 3 != 0).alias("truth"), "conf", F.explode(F.array(F.lit(3), F.lit(6))).alias("m"))
    found = F.col("conf") >= F.lit(0.1) * F.col("m")
    hits = F.count_if(found & F.col("truth"))
    out = rows.groupBy("domain", F.concat(F.lit("model "), F.col("m").cast("string")).alias("model")).agg(hits.alias("hits"), F.count_if("truth").alias("all"), F.count_if(found & ~F.col("truth")).alias("extra"))
    return out.where(F.col("all") > 0).select("domain", "model", "hits", F.round(F.col("hits") / F.col("all"), 6).alias("recall"), "extra")


@registered(
    """WITH r AS (SELECT user_id % 40 AS g, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id % 40) AS n FROM events)
    SELECT g, round(max(value) FILTER (WHERE i = n // 2 + 1), 6) AS upper_median, round(max(value) FILTER (WHERE i = cast(floor(n * 0.5) AS int) + 1), 6) AS p50, round(max(value) FILTER (WHERE i = cast(floor(n * 0.99) AS int) + 1), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM r GROUP BY g"""
)
def latency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and values by index of the sorted list, the upper median among them, for forty groups."""
    rows = view(spark, sf_dir, "SELECT user_id % 40 AS g, value FROM events").groupBy("g").agg(F.sort_array(F.collect_list("value")).alias("l"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    n = F.size("l")
    at = lambda k: F.round(F.get("l", k.cast("int")), 6)
    return rows.select("g", at(F.floor(n / 2)).alias("upper_median"), at(F.floor(n * F.lit(0.5))).alias("p50"), at(F.floor(n * F.lit(0.99))).alias("p99"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@registered(
    """WITH p AS (SELECT sec, rank() OVER (ORDER BY round(risk, 9) DESC, sec) AS place, count(*) OVER () AS n FROM risk), f AS (SELECT DISTINCT cast(floor(cls_num) AS int) AS sec FROM flags JOIN catalog USING (call, cls) WHERE resolved = 1)
    SELECT p.sec, p.place, round(1 - (p.place - 1) / n, 6) AS percent_rank, p.place <= n / 2 AS top_half FROM p JOIN f ON f.sec = p.sec"""
)
def field_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sections with misplaced books in the field stand in the ranking by risk."""
    places = view(spark, sf_dir, "SELECT sec, risk FROM risk").withColumns({"place": F.row_number().over(Window.orderBy(F.desc(F.round("risk", 9)), "sec")), "n": F.count("*").over(Window.partitionBy())})  # a row for each section
    found = view(spark, sf_dir, "SELECT DISTINCT cls FROM flags WHERE resolved = 1").select(F.floor(F.col("cls").cast("double")).cast("int").alias("sec")).distinct()
    return places.join(found, "sec").select("sec", F.col("place").cast("long").alias("place"), F.round(1 - (F.col("place") - 1) / F.col("n"), 6).alias("percent_rank"), (F.col("place") <= F.col("n") / 2).alias("top_half"))


@registered("SELECT count(*) FILTER (WHERE mis = 0) AS confirmed, count(*) FILTER (WHERE mis = 1 AND resolved = 0) AS open, count(*) FILTER (WHERE mis = 1 AND resolved = 1) AS resolved FROM flags")
def session_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    mis, resolved = F.col("mis") == 1, F.col("resolved") == 1
    return view(spark, sf_dir, "SELECT mis, resolved FROM flags").agg(F.count_if(~mis).alias("confirmed"), F.count_if(mis & ~resolved).alias("open"), F.count_if(mis & resolved).alias("resolved"))


@registered(
    """WITH t AS (SELECT unnest([90, 91, 92, 93, 94, 95, 96]) AS step), s AS (SELECT cast(round(score * 100) AS int) AS k, how, supp FROM spine) SELECT step, count(*) FILTER (WHERE k >= step) AS covered, count(*) FILTER (WHERE k >= step AND how = 'direct') AS matched,
    count(*) FILTER (WHERE k >= step AND how = 'direct' AND supp % 7 = 0) AS misplaced, round(count(*) FILTER (WHERE k >= step AND how = 'direct' AND supp % 7 = 0) / greatest(1, count(*) FILTER (WHERE k >= step AND how = 'direct')), 6) AS ratio FROM s, t GROUP BY step"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven thresholds: rows covered, matched, misplaced, and their ratio. Rows are counted once for each score, so seven times few rows are compared."""
    rows = view(spark, sf_dir, "SELECT cast(round(score * 100) AS int) AS k, how, supp FROM spine")
    direct = F.col("how") == "direct"
    counts = rows.groupBy("k").agg(F.count("*").alias("c"), F.count_if(direct).alias("m"), F.count_if(direct & (F.col("supp") % 7 == 0)).alias("w"))
    out = counts.withColumn("step", F.explode(F.array(*map(F.lit, range(90, 97))))).groupBy("step").agg(*(F.coalesce(F.sum(F.when(F.col("k") >= F.col("step"), F.col(c))), F.lit(0)).alias(n) for c, n in (("c", "covered"), ("m", "matched"), ("w", "misplaced"))))
    return out.withColumn("ratio", F.round(F.col("misplaced") / F.greatest(F.lit(1), "matched"), 6))


@registered(
    """WITH RECURSIVE p AS (SELECT ord, rank() OVER (ORDER BY cls_num, substr(author, 1, 1), cutter, tail, vol, ord) AS k FROM catalog), r AS (SELECT scan, band, k, row_number() OVER (PARTITION BY scan, band ORDER BY pos) AS i FROM spine JOIN p ON p.ord = spine.ord WHERE how <> 'none'),
    c AS (SELECT scan, band, i, k, 1 AS n FROM r UNION SELECT r.scan, r.band, r.i, r.k, c.n + 1 FROM c JOIN r ON r.scan = c.scan AND r.band = c.band AND r.i > c.i AND r.k >= c.k) SELECT r.scan, r.band, round(max(n) / count(DISTINCT r.i), 6) AS consistency FROM r JOIN c ON c.scan = r.scan AND c.band = r.band GROUP BY r.scan, r.band"""
)
def sort_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a band's read books that stand in order."""
    places = sequence.placed(view(spark, sf_dir, "SELECT ord, call FROM catalog").withColumn("key", text.sort_key("call")), ["key", "ord"]).select("ord", F.col("place").alias("key"))
    judged = sequence.judge(view(spark, sf_dir, "SELECT scan, band, pos, ord FROM spine WHERE how <> 'none'").join(places, "ord"))
    return judged.groupBy("scan", "band").agg(F.round(F.count_if(~F.col("misplaced")) / F.count("*"), 6).alias("consistency"))


# --- sets, splits, samples -------------------------------------------------------------------

_ANSWERS = "(SELECT user_id AS id, event_id AS seen, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS call FROM events) x"


@registered(f"SELECT id, a.call, a.call IS NULL AS notlabel FROM (SELECT id, max(seen) AS seen FROM {_ANSWERS} GROUP BY id) m JOIN {_ANSWERS.replace(') x', ') a')} USING (id, seen)")
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer for each crop; 'not a label' (null) and a label retract each other."""
    last = view(spark, sf_dir, f"SELECT * FROM {_ANSWERS}").groupBy("id").agg(F.max_by(F.struct("call"), "seen").alias("a"))
    return last.select("id", "a.call", F.col("a.call").isNull().alias("notlabel"))


@registered("SELECT scan, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[:6], ',') AS offered FROM (SELECT scan, list_concat(list(call ORDER BY pos DESC) FILTER (WHERE how = 'direct'), list(call ORDER BY pos) FILTER (WHERE how <> 'none')) AS l FROM spine GROUP BY scan) x WHERE len(l) > 0")
def offered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the order first, then from reading, without repeats, six at most."""
    rows = view(spark, sf_dir, "SELECT scan, pos, call, how FROM spine WHERE how <> 'none'").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("pos", "call", "how"))).alias("l"))
    direct = F.reverse(F.filter("l", lambda r: r["how"] == "direct"))
    calls = F.slice(F.array_distinct(F.transform(F.concat(direct, F.col("l")), lambda r: r["call"])), 1, 6)
    return rows.select("scan", F.array_join(calls, ",").alias("offered"))


@registered("SELECT url, min(page_id) AS page_id, count(*) AS times FROM pages GROUP BY url")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address, which later ones of the same address don't replace."""
    return view(spark, sf_dir, "SELECT url, page_id FROM pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("times"))


@registered(
    """WITH q AS (SELECT scan, pos, floor(x0 / 12 + 0.5) AS qx, floor(y0 / 12 + 0.5) AS qy, coalesce(call, '') AS t FROM detections) SELECT scan, min(pos) AS pos, cast(qx AS bigint) AS qx, cast(qy AS bigint) AS qy, t FROM q GROUP BY scan, qx, qy, t"""
)
def token_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token for each text and cell of twelve by twelve, the first."""
    cell = lambda c: F.floor(F.col(c) / 12 + 0.5).alias(f"q{c[0]}")
    rows = view(spark, sf_dir, "SELECT scan, pos, x0, y0, call FROM detections").select("scan", "pos", cell("x0"), cell("y0"), F.coalesce("call", F.lit("")).alias("t"))
    return rows.groupBy("scan", "qx", "qy", "t").agg(F.min("pos").alias("pos"))


_KEYED = "(SELECT call, count(*) AS n, min(ord) AS ord FROM holdings GROUP BY call) x"


@registered(
    f"""WITH o AS (SELECT call, n, md5('7' || call) AS h FROM {_KEYED}), s AS (SELECT call, n, (SELECT sum(b.n) FROM o b WHERE b.h < o.h) AS before FROM o) SELECT call, n, CASE WHEN coalesce(before, 0) < 0.15 * (SELECT sum(n) FROM o) THEN 'val' ELSE 'train' END AS part FROM s"""
)
def group_split(spark: SparkSession, sf_dir: str, share: float = 0.15, seed: str = "7") -> DataFrame:
    """Keys in a seeded order go to validation until it has its share of the rows, so no key is on both sides."""
    keys = view(spark, sf_dir, f"SELECT call, n FROM {_KEYED}").withColumn("h", F.md5(F.concat(F.lit(seed), "call")))
    part = keys.withColumn("p", F.substring("h", 1, 3))  # 4096 ranges that don't depend on how rows are dealt
    part = part.withColumn("own", F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = part.groupBy("p").agg(F.sum("n").alias("s"))
    sums = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"), F.sum("s").over(Window.partitionBy()).alias("total"))
    return part.join(F.broadcast(sums), "p").select("call", "n", F.when(F.col("shift") + F.col("own") < share * F.col("total"), "val").otherwise("train").alias("part"))


@registered(
    """WITH h AS (SELECT scan, pos, y1 - y0 AS height, flag, md5(cast(scan AS string) || ':' || cast(pos AS string)) AS h FROM detections), r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY h) AS i, count(*) OVER (PARTITION BY scan) AS n FROM h)
    SELECT scan, pos, CASE WHEN height >= 42 THEN 'close' ELSE 'low' END AS tag, i <= greatest(2, n // 6) AS val, c AS copy FROM r, (SELECT unnest(range(1, 7)) AS c) k WHERE c <= CASE WHEN scan % 10 = 0 THEN 3 WHEN flag = 'A' THEN 6 WHEN flag = 'N' THEN 2 ELSE 4 END"""
)
def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tagged by height, a seeded validation part of each scan, and copies by weight (6, 2 and 4; three for chosen scans)."""
    rows = view(spark, sf_dir, "SELECT scan, pos, y1 - y0 AS height, flag FROM detections")
    order = F.md5(F.concat_ws(":", F.col("scan").cast("string"), F.col("pos").cast("string")))
    rows = rows.withColumns({"i": F.row_number().over(Window.partitionBy("scan").orderBy(order)), "n": F.count("*").over(Window.partitionBy("scan"))})
    weight = F.when(F.col("scan") % 10 == 0, 3).when(F.col("flag") == "A", 6).when(F.col("flag") == "N", 2).otherwise(4)
    return rows.select("scan", "pos", F.when(F.col("height") >= 42, "close").otherwise("low").alias("tag"), (F.col("i") <= F.greatest(F.lit(2), F.floor(F.col("n") / 6))).alias("val"), F.explode(F.sequence(F.lit(1), weight)).alias("copy"))


@registered("SELECT id, pos, call, conf FROM (SELECT scan AS id, pos, call, conf, row_number() OVER (PARTITION BY scan ORDER BY conf DESC, pos) AS rn, count(*) FILTER (WHERE call IS NOT NULL) OVER (PARTITION BY scan) AS n FROM detections) x WHERE rn <= 2 AND n >= 1")
def sharpest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sharpest crops of each scan that has a call."""
    rows = view(spark, sf_dir, "SELECT scan AS id, pos, call, conf FROM detections")
    rows = rows.withColumns({"rn": F.row_number().over(Window.partitionBy("id").orderBy(F.desc("conf"), "pos")), "n": F.count("call").over(Window.partitionBy("id"))})
    return rows.where("rn <= 2 and n >= 1").select("id", "pos", "call", "conf")


@registered("SELECT call, n, place FROM (SELECT call, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, call) AS place FROM detections WHERE call IS NOT NULL GROUP BY call) x WHERE place <= 10")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent calls."""
    top = view(spark, sf_dir, "SELECT call FROM detections WHERE call IS NOT NULL").groupBy("call").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "call").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "call")))


# --- geometry --------------------------------------------------------------------------------


def centred(width: Column, height: Column) -> list[Column]:
    """The box of a row as centre and size, as shares of a picture."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return [((x0 + x1) / 2 / width).alias("cx"), ((y0 + y1) / 2 / height).alias("cy"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h")]


def cornered(width: Column, height: Column) -> list[Column]:
    """The corners of a box given as centre and size."""
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return [((cx - w / 2) * width).alias("x0"), ((cy - h / 2) * height).alias("y0"), ((cx + w / 2) * width).alias("x1"), ((cy + h / 2) * height).alias("y1")]


@registered(
    """SELECT scan, pos, round(y1 - 0.4 * (y1 - y0), 6) AS bottom40, round(y0 + 0.54 * (y1 - y0), 6) AS from54, round(y0 + 0.62 * (y1 - y0), 6) AS to62, round((x0 + x1) / 1000, 6) AS cx, round((y1 - y0) / 300, 6) AS h, x0 AS back_x0, y1 AS back_y1,
        round(200 + (x1 - 200) * cos(radians(10)) - (y0 - 150) * sin(radians(10)), 6) AS turned_x, round(150 + (x1 - 200) * sin(radians(10)) + (y0 - 150) * cos(radians(10)), 6) AS turned_y FROM detections"""
)
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label boxes within spines, boxes as centre and size and back, and a corner turned by ten degrees about the middle of the picture."""
    w, h = F.lit(500.0), F.lit(300.0)
    rows = view(spark, sf_dir, "SELECT scan, pos, x0, y0, x1, y1 FROM detections")
    there = rows.select("*", *centred(w, h))
    back = there.select("scan", "pos", "cx", "cy", "w", "h", *cornered(w, h)).select("scan", "pos", F.round("x0", 6).alias("back_x0"), F.round("y1", 6).alias("back_y1"))
    tall, a = F.col("y1") - F.col("y0"), F.radians(F.lit(10.0))
    x, y = F.col("x1") - 200, F.col("y0") - 150
    forms = there.select(
        "scan", "pos", F.round(F.col("y1") - 0.4 * tall, 6).alias("bottom40"), F.round(F.col("y0") + 0.54 * tall, 6).alias("from54"), F.round(F.col("y0") + 0.62 * tall, 6).alias("to62"), F.round("cx", 6).alias("cx"), F.round("h", 6).alias("h"),
        F.round(200 + x * F.cos(a) - y * F.sin(a), 6).alias("turned_x"), F.round(150 + x * F.sin(a) + y * F.cos(a), 6).alias("turned_y"),
    )
    return forms.join(back, ["scan", "pos"])


@registered(
    """WITH t AS (SELECT scan, pos, x0, y0, x1, y1, tx, ty FROM detections, (SELECT unnest(range(0, 401, 100)) AS tx) a, (SELECT unnest(range(0, 101, 50)) AS ty) b), c AS (SELECT *, greatest(x0, tx) AS cx0, greatest(y0, ty) AS cy0, least(x1, tx + 150) AS cx1, least(y1, ty + 100) AS cy1 FROM t)
    SELECT scan, pos, tx, ty, cx0 - tx AS x0, cy0 - ty AS y0, cx1 - tx AS x1, cy1 - ty AS y1 FROM c WHERE cx1 > cx0 AND cy1 > cy0 AND (cx1 - cx0) * (cy1 - cy0) >= 0.6 * (x1 - x0) * (y1 - y0)"""
)
def tiled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut to overlapping tiles of 150 by 100, kept where at least 0.6 of the box lies inside. A box meets only the tiles that it reaches."""
    rows = view(spark, sf_dir, "SELECT scan, pos, x0, y0, x1, y1 FROM detections")

    def starts(lo: str, hi: str, size: int, stride: int, last: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(lo) - size) / stride)).cast("int")
        end = F.least(F.lit(last), F.floor(F.col(hi) / stride)).cast("int")
        return F.when(first <= end, F.transform(F.sequence(first, F.greatest(first, end)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("tx", F.explode(starts("x0", "x1", 150, 100, 4))).withColumn("ty", F.explode(starts("y0", "y1", 100, 50, 2)))
    cut = rows.withColumns({"a": F.greatest("x0", "tx"), "b": F.greatest("y0", "ty"), "c": F.least(F.col("x1"), F.col("tx") + 150), "d": F.least(F.col("y1"), F.col("ty") + 100)})
    inside = (F.col("c") > F.col("a")) & (F.col("d") > F.col("b")) & ((F.col("c") - F.col("a")) * (F.col("d") - F.col("b")) >= 0.6 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return cut.where(inside).select("scan", "pos", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), (F.col("a") - F.col("tx")).alias("x0"), (F.col("b") - F.col("ty")).alias("y0"), (F.col("c") - F.col("tx")).alias("x1"), (F.col("d") - F.col("ty")).alias("y1"))


@registered("SELECT scan, pos, CASE WHEN abs(x0 - m) > 180 THEN m ELSE x0 END AS x0 FROM (SELECT scan, pos, x0, median(x0) OVER (PARTITION BY scan) AS m FROM detections) x")
def repaired_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges more than 180 from the median of their scan are set to it."""
    rows = view(spark, sf_dir, "SELECT scan, pos, x0 FROM detections").withColumn("m", F.median("x0").over(Window.partitionBy("scan")))
    return rows.select("scan", "pos", F.when(F.abs(F.col("x0") - F.col("m")) > 180, F.col("m")).otherwise(F.col("x0")).alias("x0"))


@registered(
    """WITH m AS (SELECT user_id AS s, event_id AS f, event_type = 'view' AS still FROM events), g AS (SELECT *, count(*) FILTER (WHERE NOT still) OVER (PARTITION BY s ORDER BY f) AS k FROM m)
    SELECT s, f, still AND (row_number() OVER (PARTITION BY s, k, still ORDER BY f) - 1) % 4 < 3 AND k > 0 AS reused FROM g"""
)
def motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Still frames reuse the boxes of the one before, three in a row at most; then one is detected anew. Motion resumes at once."""
    w = Window.partitionBy("s").orderBy("f")
    rows = view(spark, sf_dir, "SELECT user_id AS s, event_id AS f, event_type = 'view' AS still FROM events")
    rows = rows.withColumn("k", F.sum(F.when(F.col("still"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.sum(F.when(F.col("still"), 1).otherwise(0)).over(Window.partitionBy("s", "k").orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("s", "f", (F.col("still") & (F.col("k") > 0) & ((place - 1) % 4 < 3)).alias("reused"))


@registered("SELECT extract(minute FROM ts) AS minute, count(*) AS frames FROM events WHERE event_id % 30 = 0 GROUP BY 1")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of thirty, by number, counted by minute: the sampling is the operator."""
    return view(spark, sf_dir, "SELECT event_id, ts FROM events").where(F.col("event_id") % 30 == 0).groupBy(F.minute("ts").cast("long").alias("minute")).agg(F.count("*").alias("frames"))


@registered("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn % 5 = 1")
def every_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth photo of each walk (a customer), in name order."""
    rows = view(spark, sf_dir, "SELECT o_orderkey, o_custkey FROM orders")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("rn % 5 = 1").select("o_orderkey")


@registered("SELECT user_id, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quartiles, median and ninth decile of each user's values."""
    made = [F.round(F.percentile("value", F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9)]
    return view(spark, sf_dir, "SELECT user_id, value FROM events").groupBy("user_id").agg(*made)
