"""The registered shelf queries: one SQL text for each, rendered for Spark and for the DuckDB oracle.

``VIEWS`` bind the test tables to shelf tables (catalog, spine rows, readings, votes, feeds). A query
names the views it uses; only those are put in front of it. The two dialects differ in a few functions,
which ``Dialect`` spells. Catalyst plans the text; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}'" + (", 'g')" if self.duck else ")")

    def extract(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})" if self.duck else f"percentile({x}, {p})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS double)"

    def millis(self, x: str) -> str:
        return f"epoch_ms({x})" if self.duck else f"unix_millis(cast({x} AS timestamp))"


SPARK, DUCK = Dialect(False), Dialect(True)
KEY = "cls_num, substr(author, 1, 1), cutter, tail, vol"

VIEWS: dict[str, Callable[[Dialect], str]] = {
    "catalog": lambda d: """
        SELECT ord, cls, cast(cls AS double) AS cls_num, author, cast('0.' || substr(author, 2, 2) AS double) AS cutter, substr(author, 4, 1) AS tail, vol, title, status, isbn13,
               cls || '-' || author || CASE WHEN vol > 0 THEN '-v.' || cast(vol AS string) ELSE '' END AS call
        FROM (SELECT p_partkey AS ord, lpad(cast((p_partkey % 97) * 10 AS string), 3, '0') || CASE WHEN p_size % 3 = 0 THEN '.' || cast(p_size % 4 AS string) ELSE '' END AS cls,
                     substr('가나다', cast(p_partkey % 3 AS int) + 1, 1) || cast(10 + p_size % 4 AS string) || substr('ㄱㄴㄷ', cast(length(p_name) % 3 AS int) + 1, 1) AS author,
                     CASE WHEN p_size % 5 = 0 THEN 1 + p_size % 4 ELSE 0 END AS vol, p_name || ' : ' || p_type AS title,
                     CASE WHEN (p_partkey * 7) % 11 < 3 THEN 'loan' ELSE 'shelf' END AS status, '978' || lpad(cast(p_partkey AS string), 10, '0') AS isbn13
              FROM part) p""",
    "holdings": lambda d: """
        SELECT ord, cls, mark, vol, title, status, isbn13, cls || '-' || mark || CASE WHEN vol > 0 THEN '-v.' || cast(vol AS string) ELSE '' END || CASE WHEN ord % 13 = 0 THEN '=2' WHEN ord % 17 = 0 THEN ' c.3' ELSE '' END AS call
        FROM (SELECT p_partkey AS ord, lpad(cast((p_partkey % 97) * 10 AS string), 3, '0') || CASE WHEN p_size % 3 = 0 THEN '.' || cast(p_size % 4 AS string) ELSE '' END AS cls,
                     substr('가ㄴ나다라', cast(p_partkey % 5 AS int) + 1, 1) || CASE WHEN p_partkey % 4 = 0 THEN cast(100 + p_partkey % 900 AS string) ELSE cast(10 + (p_partkey * 7) % 80 AS string) END || substr('ㄱㄴㅇ', cast(p_partkey % 3 AS int) + 1, 1) AS mark,
                     CASE WHEN p_size % 5 = 0 THEN 1 + p_size % 12 ELSE 0 END AS vol, p_name || ' : ' || p_type AS title, CASE WHEN (p_partkey * 7) % 11 < 3 THEN 'loan' ELSE 'shelf' END AS status, '978' || lpad(cast(p_partkey AS string), 10, '0') AS isbn13
              FROM part) p""",
    "asked": lambda d: """
        SELECT l_orderkey AS scan, l_linenumber AS line, l_partkey AS ord, l_suppkey AS supp, call AS truth, title,
               CASE (l_orderkey + l_partkey) % 11 WHEN 0 THEN cls || ' ' || mark WHEN 1 THEN cls || ' v.' || cast(vol AS string) || ' ' || mark WHEN 2 THEN cls || ' ' || substr(mark, 1, cast(length(mark) - 1 AS int)) || '0'
               WHEN 3 THEN cls || ' 바' || substr(mark, 2) WHEN 4 THEN mark WHEN 5 THEN '9' || substr(cls, 2) || '9 ' || mark WHEN 6 THEN cls || ' ' || substr(mark, 1, 1) || substr(mark, 3) WHEN 7 THEN 'xx ' || cls
               WHEN 8 THEN cls || ' ' || mark || ' v.' || cast(vol AS string) WHEN 9 THEN '999.9 ' || mark || ' ' || cls || ' ' || mark ELSE 'noise' END AS read
        FROM lineitem JOIN holdings ON ord = l_partkey""",
    "detections": lambda d: """
        SELECT l_orderkey AS scan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, cast(l_partkey % 400 AS double) AS x0, cast(20 * (l_suppkey % 5) AS double) AS y0,
               cast(l_partkey % 400 + 20 + l_suppkey % 20 AS double) AS x1, cast(20 * (l_suppkey % 5) + 30 + l_partkey % 25 AS double) AS y1, l_discount * 10 AS conf, CASE WHEN l_returnflag = 'A' THEN cast(l_partkey % 40 AS string) END AS call, l_returnflag AS flag, l_partkey AS part
        FROM lineitem""",
    "calls": lambda d: "SELECT call, min(ord) AS ord, min(cls) AS cls, min(author) AS author, count(*) AS copies FROM catalog GROUP BY call",
    "spine": lambda d: """
        SELECT l.l_orderkey AS scan, l.l_suppkey % 2 AS band, l.pos, 40.0 * l.pos AS x0, 40.0 * l.pos + 30.0 AS x1, c.cls, c.author, c.call, c.title, c.ord, c.cls_num, c.cutter, c.tail, c.vol, c.status,
               CASE l.l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'title' ELSE 'none' END AS how, round(1 - l.l_discount, 4) AS score, l.l_tax AS jitter, l.l_suppkey AS supp
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem) l JOIN catalog c ON c.ord = l.l_partkey""",
    "confirmed": lambda d: "SELECT * FROM spine WHERE how <> 'none'",
    "photos": lambda d: "SELECT o_orderkey AS id, cast(cast(o_orderdate AS date) AS string) AS day, o_orderpriority AS device FROM orders",
    "flags": lambda d: """
        SELECT scan, band, pos, call, cls, how, CASE WHEN below > 0 AND how = 'direct' THEN 1 ELSE 0 END AS mis, CASE WHEN below > 0 AND how = 'direct' AND supp % 3 = 0 THEN 1 ELSE 0 END AS resolved
        FROM (SELECT *, CASE WHEN cls_num < max(cls_num) OVER (PARTITION BY scan, band ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS below FROM confirmed) x""",
    "readings": lambda d: """
        SELECT scan, pos, call AS truth, CASE ord % 7 WHEN 0 THEN cls || ' ' || substr(author, 1, 3) || '0' WHEN 1 THEN cls || substr(author, 1, 1) || substr(author, 2, 2) || tail || ' v.' || cast(vol AS string)
               WHEN 2 THEN cls || '라' || substr(author, 2, 3) WHEN 3 THEN cls || '-' || author WHEN 4 THEN author ELSE cls || ' ' || author END AS read
        FROM spine WHERE how = 'direct'""",
    "parsed": lambda d: f"""
        SELECT scan, pos, truth, read, {d.extract("t", "^([0-9]{3}([.][0-9]+)?)", 1)} AS cls, {d.extract("t", "([가-힣][0-9]{1,3}[가-힣ㄱ-ㅎ0Oo]?)$", 1)} AS mark
        FROM (SELECT *, {d.replace(d.replace("read", "[vV][.]?[0-9]+", " "), "[^0-9A-Za-z가-힣ㄱ-ㅎ.]", "")} AS t FROM readings) x""",
    "votes": lambda d: "SELECT user_id % 3 AS video, extract(hour FROM ts) AS frame, event_type || cast(user_id % 10 AS string) AS call, value FROM events",
    "truth": lambda d: "SELECT DISTINCT call FROM votes WHERE video = 0",
    "popular": lambda d: "SELECT p.isbn13, p.title, cast(sum(l_quantity) AS bigint) AS loans FROM lineitem JOIN catalog p ON p.ord = l_partkey GROUP BY p.isbn13, p.title",
    "answers": lambda d: "SELECT user_id AS id, event_id AS seen_at, event_type AS answer FROM events",
    "ranked": lambda d: f"SELECT *, row_number() OVER (ORDER BY {KEY}, ord) AS place FROM catalog",  # for oracles; Spark numbers places by range partitions
    "features": lambda d: """
        SELECT sec, count(*) AS n, avg(loan) AS loan_rate, avg(series) AS series_rate, coalesce(avg(crowd), 0) AS crowd_rate
        FROM (SELECT cast(floor(cls_num) AS int) AS sec, CASE WHEN status <> 'shelf' THEN 1.0 ELSE 0.0 END AS loan,
                     CASE WHEN count(*) OVER (PARTITION BY cast(floor(cls_num) AS int), cls, author) >= 2 THEN 1.0 ELSE 0.0 END AS series,
                     CASE WHEN length(author) < 2 THEN NULL WHEN count(*) OVER (PARTITION BY cls, substr(author, 1, 2)) >= 2 THEN 1.0 ELSE 0.0 END AS crowd FROM catalog) x
        GROUP BY sec HAVING count(*) >= 15""",
    "risk": lambda d: """
        SELECT sec, n, z_loan, z_series + z_crowd AS vulnerability, z_series + z_crowd + z_loan AS risk
        FROM (SELECT sec, n, (loan_rate - avg(loan_rate) OVER ()) / coalesce(nullif(stddev_pop(loan_rate) OVER (), 0), 1) AS z_loan,
                     (series_rate - avg(series_rate) OVER ()) / coalesce(nullif(stddev_pop(series_rate) OVER (), 0), 1) AS z_series,
                     (crowd_rate - avg(crowd_rate) OVER ()) / coalesce(nullif(stddev_pop(crowd_rate) OVER (), 0), 1) AS z_crowd FROM features) x""",
    "boxes": lambda d: "SELECT scan, pos, band, x0, x0 + 30.0 AS x1, 100.0 * band + (supp % 7) AS y0, 100.0 * band + (supp % 7) + 60.0 AS y1, how, call, score FROM spine",
    "tokens": lambda d: "SELECT scan, pos AS token, x0 + 15.0 + 400.0 * (jitter - 0.04) AS x, call AS text FROM spine",
    "frames": lambda d: "SELECT video, frame, call, count(*) AS seen FROM votes GROUP BY video, frame, call",
}

NORM = "[ _/.-]"

SQL: dict[str, Callable[[Dialect], str]] = {
    # projections and normalisation
    "catalog_clean": lambda d: "SELECT ord, call, title, CASE WHEN cls >= '000' THEN substr(cls, 1, 1) || '00' ELSE 'other' END AS section FROM catalog WHERE status IN ('shelf', 'loan') AND trim(call) <> ''",
    "norm_text": lambda d: f"SELECT ord, lower({d.replace('call', NORM, '')}) AS norm, {d.replace('lower(title)', '[^0-9a-z가-힣]', '')} AS norm_title, {d.replace('call', '[^0-9A-Za-z가-힣ㄱ-ㅎ.]', '')} AS mark_text FROM catalog",
    "call_parse": lambda d: f"SELECT ord, {d.number(d.extract('call', '^[0-9]{1,3}([.][0-9]+)?'))} AS class_num, {d.extract('call', '-([가-힣ㄱ-ㅎ][0-9가-힣ㄱ-ㅎ]*)', 1)} AS author_mark, coalesce(try_cast(nullif({d.extract('call', 'v[.]([0-9]+)$', 1)}, '') AS int), 0) AS volume FROM catalog",
    "copy_suffix": lambda d: f"SELECT ord, {d.replace(f'''call || CASE ord % 3 WHEN 0 THEN '=2' WHEN 1 THEN ' c.3' ELSE '' END''', '( *[cC][.]|=)[0-9]+$', '')} AS call FROM catalog",
    "volume_token": lambda d: f"SELECT scan, pos, {d.replace('read', '[vV][.]?[0-9]+', ' ')} AS without, try_cast(nullif({d.extract('read', '[vV][.]?([0-9]+)', 1)}, '') AS int) AS volume FROM readings",
    "isbn_norm": lambda d: f"SELECT ord, CASE WHEN length({d.replace('raw', '[^0-9]', '')}) = 13 THEN {d.replace('raw', '[^0-9]', '')} END AS isbn FROM (SELECT ord, CASE WHEN ord % 4 = 0 THEN substr(isbn13, 1, 10) ELSE substr(isbn13, 1, 3) || '-' || substr(isbn13, 4, 10) END AS raw FROM catalog) x",
    "section_of": lambda d: f"SELECT ord, CASE WHEN {d.extract('cls', '^[0-9]{3}')} <> '' THEN substr(cls, 1, 1) || '00' ELSE 'other' END AS section FROM catalog",
    "shelf_sorted": lambda d: f"SELECT ord, call, row_number() OVER (PARTITION BY cls ORDER BY {KEY}, ord) AS place FROM catalog",
    # filters and gates
    "status_filter": lambda d: "SELECT ord, call, status FROM catalog WHERE status = 'shelf' AND trim(call) <> ''",
    "spike_filter": lambda d: "SELECT scan, band, pos FROM (SELECT *, lag(cls_num) OVER w AS b, lead(cls_num) OVER w AS a FROM confirmed WINDOW w AS (PARTITION BY scan, band ORDER BY pos)) x WHERE cls_num < b - 1 AND cls_num < a - 1 AND b <= a",
    "row_context_gate": lambda d: "SELECT scan, band, pos FROM (SELECT *, min(CASE WHEN how = 'direct' THEN cls_num END) OVER (PARTITION BY scan, band) AS lo, max(CASE WHEN how = 'direct' THEN cls_num END) OVER (PARTITION BY scan, band) AS hi FROM confirmed) x WHERE how = 'direct' OR lo IS NULL OR cls_num BETWEEN lo - 10 AND hi + 10",
    # joins
    "popular_owned": lambda d: "SELECT c.ord, c.call, p.loans FROM popular p JOIN catalog c ON c.isbn13 = p.isbn13",
    "recommend_owned": lambda d: "SELECT DISTINCT item, c.call FROM (SELECT l_orderkey AS item, '978' || lpad(cast(l_partkey AS string), 10, '0') AS isbn FROM lineitem) l JOIN catalog c ON c.isbn13 = l.isbn",
    "match_exact": lambda d: "SELECT p.scan, p.pos, c.call FROM parsed p JOIN calls c ON c.cls = p.cls AND c.author = p.mark",
    "match_variant": lambda d: "SELECT DISTINCT p.scan, p.pos, c.call FROM (SELECT scan, pos, cls, mark FROM parsed UNION ALL SELECT scan, pos, cls, substr(mark, 1, length(mark) - 1) || 'ㄱ' FROM parsed WHERE mark <> '') p JOIN calls c ON c.cls = p.cls AND c.author = p.mark",
    "match_first_char": lambda d: "SELECT p.scan, p.pos, min(c.author) AS author FROM parsed p JOIN calls c ON c.cls = p.cls AND length(c.author) = length(p.mark) AND substr(c.author, 2) = substr(p.mark, 2) AND substr(c.author, 1, 1) <> substr(p.mark, 1, 1) WHERE p.mark <> '' GROUP BY p.scan, p.pos HAVING count(DISTINCT c.author) = 1",
    "nearest_box": lambda d: "SELECT scan, token, pos, round(dist, 6) AS dist FROM (SELECT t.scan, t.token, b.pos, abs(t.x - (b.x0 + b.x1) / 2) AS dist, row_number() OVER (PARTITION BY t.scan, t.token ORDER BY round(abs(t.x - (b.x0 + b.x1) / 2), 6), b.pos) AS rn FROM tokens t JOIN boxes b ON b.scan = t.scan) x WHERE rn = 1 AND dist <= 60",
    "point_in_interval": lambda d: "SELECT t.scan, t.token, min(b.pos) AS pos FROM tokens t JOIN boxes b ON b.scan = t.scan AND t.x BETWEEN b.x0 AND b.x1 GROUP BY t.scan, t.token",
    "max_overlap": lambda d: "SELECT scan, a, b FROM (SELECT l.scan, l.pos AS a, r.pos AS b, row_number() OVER (PARTITION BY l.scan, l.pos ORDER BY least(l.x1 + 25, r.x1) - greatest(l.x0 + 25, r.x0) DESC, r.pos) AS rn FROM boxes l JOIN boxes r ON r.scan = l.scan AND r.pos <> l.pos AND least(l.x1 + 25, r.x1) > greatest(l.x0 + 25, r.x0)) x WHERE rn = 1",
    "iou_hits": lambda d: "SELECT scan, a, b, round(i / (w - i), 6) AS iou FROM (SELECT l.scan, l.pos AS a, r.pos AS b, (least(l.x1 + 12, r.x1) - greatest(l.x0 + 12, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS i, (l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS w FROM boxes l JOIN boxes r ON r.scan = l.scan AND r.band = l.band WHERE least(l.x1 + 12, r.x1) > greatest(l.x0 + 12, r.x0)) x WHERE i > 0 AND i / (w - i) >= 0.3",
    "loan_conflict": lambda d: "SELECT DISTINCT call, status FROM spine WHERE how <> 'none' AND status <> 'shelf'",
    "found": lambda d: f"SELECT c.call FROM calls c {'' if d.duck else 'LEFT '}SEMI JOIN (SELECT call FROM spine WHERE how = 'direct') s ON s.call = c.call",
    "before_after": lambda d: "SELECT a.video, a.call, b.n - a.n AS delta FROM (SELECT video, call, count(*) AS n FROM votes WHERE frame < 12 GROUP BY video, call) a JOIN (SELECT video, call, count(*) AS n FROM votes WHERE frame >= 12 GROUP BY video, call) b ON b.video = a.video AND b.call = a.call",
    "model_diff": lambda d: "SELECT scan, pos, CASE WHEN score >= 0.95 THEN 'a' ELSE 'b' END AS winner FROM spine WHERE (score >= 0.95) <> (jitter >= 0.04)",
    # aggregations
    "status_distribution": lambda d: "SELECT status, count(*) AS n FROM catalog GROUP BY status",
    "risk_features": lambda d: "SELECT sec, n, round(loan_rate, 6) AS loan_rate, round(series_rate, 6) AS series_rate, round(crowd_rate, 6) AS crowd_rate FROM features",
    "risk_rank": lambda d: "SELECT sec, n, round(vulnerability, 6) AS vulnerability, round(risk, 6) AS risk FROM (SELECT *, row_number() OVER (ORDER BY round(risk, 9) DESC, sec) AS rn FROM risk) x WHERE rn <= 15",
    "risk_spearman": lambda d: "SELECT round(1 - 6.0 * sum((a - b) * (a - b)) / (max(n) * (max(n) * max(n) - 1.0)), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY round(vulnerability, 9), sec) AS a, row_number() OVER (ORDER BY round(z_loan, 9), sec) AS b, count(*) OVER () AS n FROM risk) x HAVING max(n) > 1",
    "stable_votes": lambda d: "SELECT video, call, count(DISTINCT frame) AS frames FROM votes GROUP BY video, call HAVING count(DISTINCT frame) >= 2",
    "row_votes": lambda d: "SELECT video, call, count(*) AS n FROM votes GROUP BY video, call",
    "vote_tiers": lambda d: "SELECT count(*) AS one, count(CASE WHEN photos >= 2 THEN 1 END) AS two, count(CASE WHEN photos >= 3 THEN 1 END) AS three FROM (SELECT call, count(DISTINCT scan) AS photos FROM spine WHERE how <> 'none' GROUP BY call) x",
    "grade": lambda d: "SELECT s.video, round(count(t.call) * 1.0 / greatest(1, (SELECT count(*) FROM truth)), 6) AS read_rate, round(count(t.call) * 1.0 / greatest(1, count(*)), 6) AS confirm_rate FROM (SELECT video, call FROM votes GROUP BY video, call HAVING count(DISTINCT frame) >= 2) s LEFT JOIN truth t ON t.call = s.call GROUP BY s.video",
    "group_accuracy": lambda d: "SELECT how, count(*) AS n, count(CASE WHEN score >= 0.95 THEN 1 END) AS a, count(CASE WHEN jitter >= 0.04 THEN 1 END) AS b FROM spine GROUP BY how",
    "precision_recall": lambda d: "SELECT round(tp * 1.0 / greatest(1, tp + fp), 6) AS precis, round(tp * 1.0 / greatest(1, tp + fn), 6) AS recall FROM (SELECT count(CASE WHEN how = 'direct' AND score >= 0.95 THEN 1 END) AS tp, count(CASE WHEN how <> 'direct' AND score >= 0.95 THEN 1 END) AS fp, count(CASE WHEN how = 'direct' AND score < 0.95 THEN 1 END) AS fn FROM spine) x",
    "categories": lambda d: "SELECT CASE WHEN p.cls = '' THEN 'NOPREFIX' WHEN c.call IS NULL THEN 'MISSING' WHEN c.call = p.truth THEN 'CORRECT' ELSE 'MISREAD' END AS kind, count(*) AS n FROM parsed p LEFT JOIN (SELECT cls, author, min(call) AS call FROM calls GROUP BY cls, author) c ON c.cls = p.cls AND c.author = p.mark GROUP BY 1",
    "coverage": lambda d: "SELECT count(*) AS total, count(s.call) AS found FROM calls c LEFT JOIN (SELECT DISTINCT call FROM spine WHERE how = 'direct') s ON s.call = c.call",
    "tilt": lambda d: "SELECT scan, round(degrees(atan(regr_slope(y0, x0))), 6) AS tilt FROM boxes GROUP BY scan HAVING count(*) >= 3 AND max(x0) - min(x0) > 50",
    # windows and sequences
    "gap_medians": lambda d: "SELECT scan, round(median(gap), 6) AS pitch FROM (SELECT scan, x0 - lag(x0) OVER (PARTITION BY scan, band ORDER BY pos) AS gap FROM confirmed) x WHERE gap IS NOT NULL GROUP BY scan",
    "adjacent_pairs": lambda d: "SELECT scan, band, call, next_call FROM (SELECT scan, band, call, lead(call) OVER (PARTITION BY scan, band ORDER BY pos) AS next_call FROM confirmed) x WHERE next_call IS NOT NULL",
    "nearest_confirmed": lambda d: f"SELECT scan, pos, left_call, right_call FROM (SELECT scan, pos, how, last_value(CASE WHEN how <> 'none' THEN call END {'IGNORE NULLS)' if d.duck else ') IGNORE NULLS'} OVER (PARTITION BY scan ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_call, first_value(CASE WHEN how <> 'none' THEN call END {'IGNORE NULLS)' if d.duck else ') IGNORE NULLS'} OVER (PARTITION BY scan ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_call FROM spine) x WHERE how = 'none'",
    "runs": lambda d: "SELECT scan, max(n) AS longest FROM (SELECT scan, how, island, count(*) AS n FROM (SELECT scan, how, pos - row_number() OVER (PARTITION BY scan, how ORDER BY pos) AS island FROM spine) x WHERE how = 'direct' GROUP BY scan, how, island) y GROUP BY scan",
    "capacity": lambda d: "SELECT scan, pos, call FROM (SELECT s.scan, s.pos, s.call, c.copies, row_number() OVER (PARTITION BY s.call ORDER BY CASE s.how WHEN 'direct' THEN 0 ELSE 1 END, s.score DESC, s.scan, s.pos) AS rn FROM confirmed s JOIN calls c ON c.call = s.call) x WHERE rn <= greatest(1, copies)",
    "best_of": lambda d: "SELECT call, scan, pos, score FROM (SELECT call, scan, pos, score, row_number() OVER (PARTITION BY call ORDER BY score DESC, scan, pos) AS rn FROM spine) x WHERE rn = 1",
    # sets and deduplication
    "set_ops": lambda d: "SELECT call FROM ((SELECT call FROM votes WHERE video = 0 INTERSECT SELECT call FROM votes WHERE video = 1) UNION (SELECT call FROM votes WHERE video = 2 EXCEPT SELECT call FROM votes WHERE video = 0)) x",
    "hash_dedup": lambda d: "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)",
    "lww_answers": lambda d: "SELECT id, max_by(answer, seen_at) AS answer FROM answers GROUP BY id",
    # matching procedures and sampling
    "modulo_split": lambda d: "SELECT ord, CASE WHEN ord % 12 = 0 THEN 'val' ELSE 'train' END AS part FROM catalog",
    "box_centres": lambda d: "SELECT scan, pos, round((x0 + x1) / 2 / 1000, 6) AS cx, round((y0 + y1) / 2 / 1000, 6) AS cy, round((x1 - x0) / 1000, 6) AS w, round((y1 - y0) / 1000, 6) AS h FROM boxes",
    "bounded_buffer": lambda d: "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn <= 30",
}


def render(body: str, dialect: Dialect) -> str:
    """A query with the views that it needs, directly or through others, in order."""
    texts = {v: f(dialect) for v, f in VIEWS.items()}
    needed: set[str] = set()

    def need(text: str) -> None:
        for v in texts:
            if v not in needed and re.search(rf"\b(FROM|JOIN) {v}\b", text):
                needed.add(v)
                need(texts[v])

    need(body)
    order = list(VIEWS)
    order.sort(key=lambda v: v == "flags")  # flags uses confirmed only
    parts = [f"{v} AS ({texts[v]})" for v in order if v in needed]
    own = re.match(r"\s*WITH (RECURSIVE )?", body)
    if own and parts:
        text = f"WITH {own[1] or ''}{', '.join(parts)}, {body[own.end() :]}"
    else:
        text = (f"WITH {', '.join(parts)} " if parts else "") + body
    return re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])", r"\1e0", text)  # plain literals would be decimals


def run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A Spark query over the shelf views and the tables."""
    text = render(body, SPARK)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, SQL[name](SPARK))

    query.__name__ = name
    return query


QUERIES = {name: _query(name) for name in SQL}
ORACLE = {name: render(body(DUCK), DUCK) for name, body in SQL.items()}
