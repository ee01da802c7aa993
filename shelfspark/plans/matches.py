"""Registered queries that match readings against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import title_blend
from ..operators import calls
from .registry import registered, view


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT call, title, ord FROM holdings")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT DISTINCT read FROM asked")


@registered()
def match_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call and score of each reading by the cascade; a call may be missing with a score."""
    found = calls.match_call(_reads(spark, sf_dir), _catalog(spark, sf_dir))
    rows = view(spark, sf_dir, "SELECT scan, line, ord, supp, read FROM asked")
    return rows.join(found, "read").select("scan", "line", "ord", "supp", "call", F.round("score", 6).alias("score"))


_ITEMS = """c AS (SELECT ord, regexp_replace(trim(call), ' *(=|[cC][.])[0-9]+$', '') AS call FROM holdings), items AS (SELECT ord, call, split_part(call, '-', 1) AS cls, split_part(call, '-', 2) AS author FROM c),
    t AS (SELECT read, regexp_replace(regexp_replace(read, '[vV][.]?[0-9]+', ' ', 'g'), '[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ.]', '', 'g') AS t, ltrim(regexp_extract(read, '[vV][.]?([0-9]+)', 1), '0') AS v, regexp_matches(read, '[vV][.]?[0-9]+') AS has_v FROM (SELECT DISTINCT read FROM asked) a),
    p AS (SELECT *, regexp_extract_all(t, '([0-9]{3}(?:[.][0-9]+)?)([가-힣][0-9]{1,3}[가-힣ㄱ-ㅎ0Oo]?)', 1) AS cs, regexp_extract_all(t, '([0-9]{3}(?:[.][0-9]+)?)([가-힣][0-9]{1,3}[가-힣ㄱ-ㅎ0Oo]?)', 2) AS ms FROM t),
    u AS (SELECT read, v, has_v, unnest(cs) AS cls, unnest(ms) AS mark, unnest(range(1, len(cs) + 1)) AS i FROM p),
    k AS (SELECT read, v, has_v, arg_min(cls, i) AS cls, arg_min(mark, i) AS mark FROM u WHERE cls IN (SELECT cls FROM items) GROUP BY read, v, has_v)"""
_VOL = "(has_v AND regexp_matches(list_last(string_split(call, '-')), '^[vV]?[.]?0*' || v || '$'))"
_PICK = f"CASE WHEN count(*) FILTER (WHERE {_VOL}) = 1 THEN min(call) FILTER (WHERE {_VOL}) WHEN count(DISTINCT call) = 1 THEN min(call) END"


@registered(
    f"""WITH {_ITEMS},
    e AS (SELECT k.read, count(*) AS n, {_PICK} AS pick FROM k JOIN items i ON i.cls = k.cls AND (i.author = k.mark OR (regexp_matches(k.mark, '[0Oo]$') AND i.author = k.mark[:-2] || 'ㅇ')) GROUP BY k.read),
    r AS (SELECT k.read, CASE WHEN count(DISTINCT i.author) = 1 THEN {_PICK} END AS pick FROM k JOIN items i ON i.cls = k.cls AND length(i.author) = length(k.mark) AND i.author[2:] = k.mark[2:] AND i.author[1] <> k.mark[1] WHERE k.read NOT IN (SELECT read FROM e) GROUP BY k.read),
    w AS (SELECT read, v, has_v, unnest(regexp_extract_all(t, '[가-힣][0-9]{{2,3}}[가-힣ㄱ-ㅎ]?')) AS mark, generate_subscripts(regexp_extract_all(t, '[가-힣][0-9]{{2,3}}[가-힣ㄱ-ㅎ]?'), 1) AS i FROM p WHERE read NOT IN (SELECT read FROM k)),
    s AS (SELECT w.read, w.i, {_PICK} AS pick FROM w JOIN items x ON x.author = w.mark WHERE length(w.mark) >= 4 GROUP BY w.read, w.i),
    a AS (SELECT read, arg_max(pick, i) AS pick FROM s WHERE pick IS NOT NULL GROUP BY read)
    SELECT read, pick AS call, 1.0 AS score FROM e UNION ALL SELECT read, pick, 0.95 FROM r WHERE pick IS NOT NULL
    UNION ALL SELECT p.read, a.pick, CASE WHEN a.pick IS NULL THEN 0.0 ELSE 0.9 END FROM p LEFT JOIN a ON a.read = p.read WHERE p.read NOT IN (SELECT read FROM k)"""
)
def match_call_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without its similarities: readings that an exact stage decides, the author alone without the guard by class."""
    found = calls.match_call(_reads(spark, sf_dir), _catalog(spark, sf_dir), strict_class=False)
    return found.where("stage <> 'similar'").select("read", "call", "score")


@registered()
def match_call_before_surgery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.match_call(_reads(spark, sf_dir), _catalog(spark, sf_dir), surgery=False)
    return found.select("read", "call", F.round("score", 6).alias("score"), "stage")


_SHORT = "(SELECT DISTINCT CASE WHEN ord % 3 = 0 THEN substr(read, 1, 5) ELSE read END AS read FROM asked) x"


@registered(
    f"""WITH c AS (SELECT call, lower(regexp_replace(call, '[ _/·.-]+', '', 'g')) AS y FROM holdings), r AS (SELECT read, lower(regexp_replace(read, '[ _/·.-]+', '', 'g')) AS x FROM {_SHORT})
    SELECT read, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(call) END AS call FROM r JOIN c ON x <> '' AND (contains(x, y) OR contains(y, x)) GROUP BY read"""
)
def containment_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.match_containment(view(spark, sf_dir, f"SELECT * FROM {_SHORT}"), _catalog(spark, sf_dir))


@registered(
    f"""WITH c AS (SELECT call, lower(regexp_replace(call, '[ _/·.-]+', '', 'g')) AS y FROM holdings), r AS (SELECT read, lower(regexp_replace(read, '[ _/·.-]+', '', 'g')) AS x FROM {_SHORT}),
    m AS (SELECT read, count(*) FILTER (WHERE x = y) AS equal, min(call) FILTER (WHERE x = y) AS same, count(*) AS n, min(call) AS one FROM r JOIN c ON x <> '' AND (starts_with(x, y) OR starts_with(y, x)) GROUP BY read)
    SELECT read, CASE WHEN equal = 1 THEN same WHEN n = 1 THEN one END AS call, CASE WHEN equal = 1 THEN 1 ELSE n END AS candidates FROM m"""
)
def prefix_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.match_label(view(spark, sf_dir, f"SELECT * FROM {_SHORT}"), _catalog(spark, sf_dir))


@registered()
def match_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of the matcher over the whole catalog."""
    found = calls.match_catalog(view(spark, sf_dir, f"SELECT * FROM {_SHORT}"), _catalog(spark, sf_dir))
    return found.select("read", "call", F.round("score", 6).alias("score"), "stage")


@registered()
def match_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.match_baseline(_reads(spark, sf_dir), _catalog(spark, sf_dir))
    return found.select("read", "call", F.round("score", 6).alias("score"))


_SERIES = "(SELECT '408-뉴88-' || cast(n AS string) AS call, 'volume ' || cast(n AS string) AS title, n AS ord FROM (SELECT DISTINCT p_size AS n FROM part) x) x"
_SPINES = "(SELECT l_orderkey AS scan, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, CASE l_suppkey % 4 WHEN 0 THEN '408 뉴88 ' || cast(l_partkey % 60 AS string) WHEN 1 THEN '뉴88 ' || cast(l_partkey % 60 AS string) || ' c' WHEN 2 THEN 'other ' || cast(l_partkey % 60 AS string) ELSE cast(l_partkey % 60 AS string) || ' 408' END AS read FROM lineitem) y"


@registered(
    f"""SELECT DISTINCT read, CASE WHEN regexp_matches(read, '408|뉴88') AND n IN (SELECT p_size FROM part) AND n NOT IN (40, 48) THEN '408-뉴88-' || n END AS call FROM (SELECT read, try_cast(regexp_extract(replace(replace(read, '408', ''), '뉴88', ''), '[0-9]+') AS int) AS n FROM {_SPINES}) z"""
)
def match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series shelf by its tokens. Of the numbers here 40 and 48 resemble the prefix 408 and count as it."""
    return calls.match_tokens(view(spark, sf_dir, f"SELECT read FROM {_SPINES}"), view(spark, sf_dir, f"SELECT * FROM {_SERIES}"))


@registered(
    f"""SELECT read, arg_min(call, i) AS call FROM (SELECT DISTINCT read, i, CASE WHEN try_cast(nums[i] AS int) IN (SELECT p_size FROM part) AND nums[i] NOT LIKE '0%' AND nums[i] NOT IN ('408', '88') THEN '408-뉴88-' || nums[i] END AS call
        FROM (SELECT read, nums, unnest(range(1, greatest(len(nums), 1) + 1)) AS i FROM (SELECT read, regexp_extract_all(read, '[0-9]{{1,3}}') AS nums FROM {_SPINES}) a) b) c GROUP BY read"""
)
def match_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.match_series(view(spark, sf_dir, f"SELECT read FROM {_SPINES}"), view(spark, sf_dir, f"SELECT * FROM {_SERIES}"), "408-뉴88-", ("408", "88"))


@registered()
def retro_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and author of crops from the lines read on them, where nothing else is as likely."""
    rows = view(spark, sf_dir, "SELECT DISTINCT ord, read FROM asked").select(F.concat_ws("/", F.col("ord").cast("string"), "read").alias("id"), F.split("read", " ").alias("reads"))
    return calls.retro_call(rows, _catalog(spark, sf_dir)).select("id", "cls", "author", F.round("score", 6).alias("score"))


@registered()
def suggested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five calls that a person may choose from, for the lines of each reading of a crop; what a text suggests is found once."""
    found = calls.suggest_calls(_reads(spark, sf_dir).select(F.col("read").alias("id"), F.split("read", " ").alias("reads")), _catalog(spark, sf_dir))
    rows = view(spark, sf_dir, "SELECT DISTINCT ord, read FROM asked")
    return rows.join(found.withColumnRenamed("id", "read"), "read").select(F.concat_ws("/", F.col("ord").cast("string"), "read").alias("id"), "call", "score", "place")


_LOSSY = "regexp_replace(lower(split(title, ' : ')[0]), '([^ ]{4})[^ ]', '$1')"


@registered()
def recovered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched rows by their titles: of the two ways a title was read the better match, at 0.62 and three characters.

    Titles of this catalog repeat; the first row in catalog order has them.
    """
    titles = view(spark, sf_dir, "SELECT min(call) AS call, split(title, ' : ')[0] AS title, min(ord) AS ord FROM holdings GROUP BY split(title, ' : ')[0]")
    rows = view(spark, sf_dir, f"SELECT scan, line, ord, supp, {_LOSSY} AS upright, reverse({_LOSSY}) AS turned FROM asked WHERE read = 'noise'")
    reads = rows.select(F.explode(F.array("upright", "turned")).alias("read"))
    found = calls.match_title(reads, titles, enough=0.62, sure=2.0, margin=0.0, least=3, floor=True)
    one, two = (found.toDF(c, f"{c}_call", f"{c}_score") for c in ("upright", "turned"))
    both = rows.join(one, "upright").join(two, "turned")
    better = F.col("turned_score") > F.col("upright_score")
    out = both.select("scan", "line", "ord", "supp", F.when(better, F.col("turned_call")).otherwise(F.col("upright_call")).alias("call"), F.round(F.greatest("upright_score", "turned_score"), 6).alias("score"))
    return out.withColumn("how", F.when(F.col("call").isNotNull(), "title").otherwise("none"))


@registered()
def sibling_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main titles against those of their class with the floor of four characters; kept where the best is 0.12 above its siblings."""
    # Titles repeat: each side has a title once for each class, and a pair of titles is scored once for all classes.
    reads = view(spark, sf_dir, f"SELECT DISTINCT cls, {_LOSSY} AS read FROM holdings")
    titles = view(spark, sf_dir, "SELECT DISTINCT cls, lower(split(title, ' : ')[0]) AS cand FROM holdings")
    pairs = reads.join(titles, "cls").where("read <> cand")
    scores = pairs.select("read", "cand").distinct().withColumn("score", F.round(title_blend("read", "cand"), 6))
    scored = pairs.join(scores, ["read", "cand"])
    by = Window.partitionBy("cls", "read").orderBy(F.desc("score"), "cand")
    best = scored.withColumns({"rn": F.row_number().over(by), "next": F.lead("score").over(by)}).where("rn = 1 and score - coalesce(next, 0) > 0.12")
    return best.select("cls", "read", "cand", "score")


@registered(
    """WITH s AS (SELECT scan, pos, call, round(score, 4) * least(length(regexp_replace(call, '[^0-9A-Za-z가-힣]', '', 'g')), 12) AS score FROM spine), r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY score DESC, pos) AS rn FROM s)
    SELECT scan, pos, call, round(score, 6) AS score FROM r WHERE rn = 1 AND score > 0"""
)
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several readings the one with the most text times confidence, at most twelve characters; the first of equal ones."""
    rows = view(spark, sf_dir, "SELECT scan, pos, call, round(score, 4) AS conf FROM spine")
    rows = rows.withColumn("score", F.col("conf") * F.least(F.length(F.regexp_replace("call", "[^0-9A-Za-z가-힣]", "")), F.lit(12))).where("score > 0")
    return rows.groupBy("scan").agg(F.max_by(F.struct("pos", "call", "score"), F.struct("score", -F.col("pos"))).alias("b")).select("scan", "b.pos", "b.call", F.round("b.score", 6).alias("score"))


_EVIDENCE = "(SELECT scan, pos, CASE WHEN pos % 3 <> 0 THEN call END AS label, CASE WHEN ord % 4 = 0 THEN NULL WHEN ord % 4 = 1 THEN call ELSE 'T' || call END AS title, score AS conf FROM spine) x"


@registered(
    f"""SELECT scan, pos, coalesce(label, title) AS call, coalesce(title, label) AS call_by_title, CASE WHEN label IS NULL AND title IS NULL THEN 'none' WHEN label = title THEN 'dual' WHEN label IS NULL THEN 'title' ELSE 'call' END AS how,
        CASE WHEN label IS NOT NULL AND title IS NOT NULL THEN CASE WHEN label = title THEN 'label+title' ELSE 'label' END WHEN label IS NOT NULL THEN 'label' WHEN title IS NOT NULL THEN 'title' ELSE 'none' END AS evidence,
        CASE WHEN label IS NOT NULL OR title IS NOT NULL THEN 'ok' WHEN conf < 0.95 THEN 'unreadable' ELSE 'unknown' END AS status FROM {_EVIDENCE}"""
)
def dual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and title together: the label wins, or in the other form the title; what they say together, and the status that follows."""
    label, title = F.col("label"), F.col("title")
    how = F.when(label.isNull() & title.isNull(), "none").when(label == title, "dual").when(label.isNotNull(), "call").otherwise("title")
    kind = F.when(label == title, "label+title").when(label.isNotNull(), "label").when(title.isNotNull(), "title").otherwise("none")
    status = F.when(F.coalesce(label, title).isNotNull(), "ok").when(F.col("conf") < 0.95, "unreadable").otherwise("unknown")
    return view(spark, sf_dir, f"SELECT * FROM {_EVIDENCE}").select("scan", "pos", F.coalesce(label, title).alias("call"), F.coalesce(title, label).alias("call_by_title"), how.alias("how"), kind.alias("evidence"), status.alias("status"))


@registered(
    """WITH v AS (SELECT cls, mark, regexp_replace(call, '(=| c[.])[0-9]+$', '') AS call, regexp_extract(call, '-v[.]([0-9]+)', 1) AS own FROM holdings), a AS (SELECT DISTINCT cls, mark, n FROM (SELECT cls, mark, unnest(['1', '3', '']) AS n FROM holdings) x),
        h AS (SELECT a.cls, a.mark, a.n, count(*) AS hits, count(*) FILTER (WHERE n <> '' AND own = n) AS m, min(call) FILTER (WHERE own = n AND n <> '') AS named, count(DISTINCT call) AS d, min(call) AS one FROM a JOIN v ON v.cls = a.cls AND v.mark = a.mark GROUP BY a.cls, a.mark, a.n)
        SELECT cls, mark, n, hits, CASE WHEN m = 1 THEN named WHEN d = 1 THEN one END AS picked FROM h"""
)
def volume_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy or volume a reading with the number 1, 3 or none means, for each class and author."""
    rows = view(spark, sf_dir, "SELECT cls, mark, call FROM holdings").withColumn("volume", F.explode(F.array(F.lit("1"), F.lit("3"), F.lit(""))))
    plain = rows.withColumnRenamed("call", "whole").withColumn("call", F.regexp_replace("whole", "(=| c[.])[0-9]+$", ""))
    return plain.groupBy("cls", "mark", "volume").agg(*calls._picked(F.lit(True))).select("cls", "mark", F.col("volume").alias("n"), "hits", "picked")


CAP, NEAR, SCANNED, OFFERED = 3, 2, 40, 3
_ASCII = "translate({0}, '가나다라마바ㄱㄴㅇ', 'abcdefghi')"


@registered(
    f"""WITH m AS (SELECT DISTINCT cls, mark FROM (SELECT regexp_extract(read, '^([0-9]{{3}}([.][0-9]+)?) ', 1) AS cls, regexp_extract(read, ' ([가-힣ㄱ-ㅎ][0-9가-힣ㄱ-ㅎ]*)', 1) AS mark FROM asked) x WHERE cls <> '' AND mark <> ''),
    h AS (SELECT m.cls, m.mark, c.mark AS author, c.ord, levenshtein({_ASCII.format('m.mark')}, {_ASCII.format('c.mark')}) AS dist FROM m JOIN holdings c ON c.cls = m.cls),
    s AS (SELECT *, row_number() OVER (PARTITION BY cls, mark ORDER BY ord) AS seen FROM h WHERE dist <= {NEAR}), r AS (SELECT *, row_number() OVER (PARTITION BY cls, mark ORDER BY dist, ord) AS place FROM s WHERE seen <= {SCANNED})
    SELECT cls, mark, author, dist, place FROM r WHERE place <= {OFFERED}"""
)
def edit_distance_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a class within an edit distance of two, looked for up to three: of the first forty in catalog order the three nearest, which is the feature."""
    reads = view(spark, sf_dir, "SELECT DISTINCT read FROM asked").select(F.regexp_extract("read", "^([0-9]{3}([.][0-9]+)?) ", 1).alias("cls"), F.regexp_extract("read", " ([가-힣ㄱ-ㅎ][0-9가-힣ㄱ-ㅎ]*)", 1).alias("mark"))
    reads = reads.where("cls <> '' and mark <> ''").distinct()
    hits = reads.join(view(spark, sf_dir, "SELECT cls, mark AS author, ord FROM holdings"), "cls").withColumn("dist", F.levenshtein("mark", "author", CAP)).where(F.col("dist").between(0, NEAR))
    seen = hits.withColumn("seen", F.row_number().over(Window.partitionBy("cls", "mark").orderBy("ord"))).where(F.col("seen") <= SCANNED)
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("cls", "mark").orderBy("dist", "ord"))).where(F.col("place") <= OFFERED).select("cls", "mark", "author", "dist", "place")


@registered(
    """SELECT DISTINCT read, i - 1 AS place, cs[i] AS cls, ms[i] AS author FROM (SELECT read, cs, ms, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT read, regexp_extract_all(t, '([0-9]{3}(?:[.][0-9]+)?)([가-힣][0-9]{1,3}[가-힣ㄱ-ㅎ0Oo]?)', 1) AS cs, regexp_extract_all(t, '([0-9]{3}(?:[.][0-9]+)?)([가-힣][0-9]{1,3}[가-힣ㄱ-ㅎ0Oo]?)', 2) AS ms
        FROM (SELECT read, regexp_replace(regexp_replace(read, '[vV][.]?[0-9]+', ' ', 'g'), '[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ.]', '', 'g') AS t FROM asked) a) b) c"""
)
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with an author in each reading, by the table function ``read_pairs`` from SQL."""
    calls.register_functions(spark)
    view(spark, sf_dir, "SELECT DISTINCT read FROM asked").createOrReplaceTempView("distinct_reads")
    return spark.sql("SELECT r.read, p.place, p.cls, p.author FROM distinct_reads r, LATERAL read_pairs(r.read) p")
