"""Sources, sinks, similarity, matching and streams of the shelf operators."""

import datetime
import json
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import similarity
from shelfspark.operators import matching
from shelfspark.sources import files, sinks
from shelfspark.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_catalog_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿call_number,title\n813-가1,하나\n".encode())
    assert files.catalog_csv(spark, str(tmp_path / "c.csv")).collect() == [("813-가1", "하나")]
    with pytest.raises(ValueError, match="isbn13"):
        files.catalog_csv(spark, str(tmp_path / "c.csv"), ("isbn13",))


def test_reports_of_both_generations(spark, tmp_path):
    book = {"call": "813-가1", "mis": True}
    old, new = {"date": "2026-07-01", "device": "phone", "books": [book]}, {"date": "2026-07-02", "items": [{"file": "a.jpg", "books": [book]}, {"file": "b.jpg", "time": "10:00", "books": [{"call": None}, book]}]}
    for name, body in (("report_1.zip", old), ("report_2.zip", new), ("other.zip", old)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("r.json", json.dumps(body))
    (tmp_path / "report_3.zip").write_bytes(b"no zip")
    photos = files.reports(files.zip_members(spark, str(tmp_path / "*.zip"), prefix="report_"))
    assert sorted((r.zip, r.photo, r.date, len(r.books)) for r in photos.collect()) == [("report_1.zip", "?", "2026-07-01", 1), ("report_2.zip", "a.jpg", "2026-07-02", 1), ("report_2.zip", "b.jpg", "10:00", 2)]
    assert sorted((r.photo, r.copies) for r in files.distinct_photos(photos).collect()) == [("?", 2), ("b.jpg", 1)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert sinks.replace_if_changed(rows, path) and not sinks.replace_if_changed(rows.repartition(3), path)
    assert sinks.replace_if_changed(rows.withColumn("v", F.lit("b")), path) and sinks.current(spark, path).where("v = 'b'").count() == 3
    with pytest.raises(ValueError, match="3 rows"):
        sinks.replace_if_changed(rows.limit(1), path)
    path = str(tmp_path / "u")
    sinks.append_if_new(rows, path, "k")
    sinks.append_if_new(spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), path, "k")
    assert sorted(sinks.current(spark, path).collect(), key=lambda r: r.k) == [(1, "a"), (2, None), (3, "y")]
    sinks.union_set(rows, path)
    assert sinks.current(spark, path).count() == 3


def test_similarities(spark):
    pairs = [("가나다", "가다"), ("", ""), ("abcd", "bcda"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.matching_ratio("a", "b").alias("r"), similarity.common_substring("a", "b").alias("c"), similarity.nfc(F.lit("가")).alias("n")).collect()
    for r in got:
        assert r.n == "가" and r.r == (None if r.b is None else SequenceMatcher(None, r.a, r.b).ratio())
    assert got[2].c == 0.75


def test_fuzzy_author_equals_brute_force(spark):
    reads = matching.view(spark, SF, "SELECT scan, pos, cls, mark FROM parsed WHERE mark <> ''").collect()
    marks: dict = {}
    for r in matching.view(spark, SF, "SELECT DISTINCT cls, author FROM calls").collect():
        marks.setdefault(r.cls, []).append(r.author)
    expected = set()
    for r in reads:
        best = sorted((-round(SequenceMatcher(None, r.mark, a).ratio(), 6), a) for a in marks.get(r.cls, []))
        second = -best[1][0] if len(best) > 1 else 0.0
        if best and -best[0][0] >= 0.75 and -best[0][0] - second >= 0.05:
            expected.add((r.scan, r.pos, best[0][1]))
    got = {(r.scan, r.pos, r.author) for r in matching.fuzzy_author(spark, SF).collect()}
    assert got == expected and got
    assert matching.title_match(spark, SF).count() > 0 and matching.suggestions(spark, SF).where("rn > 3").isEmpty()


def test_streams(spark, tmp_path):
    at = datetime.datetime(2026, 7, 1, 10)
    rows = [(at + datetime.timedelta(seconds=k), "s", k // 2, "x" if k % 4 else None, k == 5, k == 2) for k in range(8)]
    schema = "ts timestamp, session string, frame int, call string, mis boolean, resolved boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def result(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return spark.table(name).collect()

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert [(r.call, r.frames, r.stable) for r in result(sessions.votes(stream), "update", "votes")] == [("x", 4, True)]
    assert [(r.call, r.mis, r.resolved) for r in result(sessions.session_books(stream), "complete", "books")] == [("x", False, True)]
    held = result(sessions.newest_rows(stream, full=6, kept=3), "update", "held")
    assert [(r.held, r.oldest) for r in held] == [(3, int(spark.createDataFrame(rows[5:6], schema).select(F.unix_millis("ts")).first()[0]))]
