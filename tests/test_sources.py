"""Sources, sinks and streams beyond the ones of the first round."""

import datetime
import json


from shelfspark.plans import board
from shelfspark.sources import files, sinks
from shelfspark.streaming import sessions


def test_loans_skip_failed_answers(spark, tmp_path):
    doc = {"doc": {"isbn13": "978-0000000001", "bookname": "A", "authors": "B", "loan_count": "12", "ranking": "1", "class_no": "8"}}
    (tmp_path / "kdc_8.json").write_text(json.dumps({"response": {"docs": [doc, {"doc": {"isbn13": "x", "bookname": None}}]}}, indent=1))
    (tmp_path / "kdc_1.json").write_text("<html>error</html>")
    (tmp_path / "kdc_2.json").write_text('{"response": {"error": "limit"}}')
    got = [tuple(r) for r in files.loans_json(spark, str(tmp_path)).orderBy("rank").collect()]
    assert sorted(got, key=str) == sorted([(8, 1, "9780000000001", "A", "B", 12), (8, None, None, None, None, None)], key=str)


def test_picks(spark, tmp_path):
    item = "<item><recomtitle>T</recomtitle><recomauthor>A</recomauthor><recomisbn>9780000000001 9780000000002 12</recomisbn><recomcontens>&amp;lt;p&amp;gt;Fine &amp;amp; dandy</recomcontens><recomYear>2020</recomYear><recomMonth>3</recomMonth><drCodeName>c</drCodeName></item>"
    (tmp_path / "y.xml").write_text(f"<channel><list>{item}</list></channel>")
    got = files.picks_xml(spark, str(tmp_path)).orderBy("isbn13").collect()
    assert [(r.isbn13, r.note, r.ym) for r in got] == [("9780000000001", "Fine & dandy", "202003"), ("9780000000002", "Fine & dandy", "202003")]


def test_logs_raw_catalog_and_labels(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\n== photo 1\nmatched 3/10\n== photo 2\nnothing\n== photo 3\nmatched 9/9")
    got = files.log_blocks(spark, str(tmp_path / "a.log"), "== photo", "matched ([0-9]+)/([0-9]+)").orderBy("block").collect()
    assert [(r.matched, r.total) for r in got] == [(3, 10), (9, 9)]
    (tmp_path / "c.csv").write_text("﻿Call,Name\n 1-a1 ,T\n", encoding="utf-8")
    assert [tuple(r) for r in files.raw_catalog(spark, str(tmp_path / "c.csv"), {"call_number": "Call", "title": "Name"}).collect()] == [("1-a1", "T")]
    (tmp_path / "p.tsv").write_text("f1\t가1\tclose\nf2\t\tlow\n", encoding="utf-8")
    assert [r.tag for r in files.pairs_tsv(spark, str(tmp_path / "p.tsv")).collect()] == ["close", "low"]
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.1 0.2\nbroken\n1 0.1 0.2 0.3 0.4\n")
    assert [(r.cls, r.w) for r in files.boxes_text(spark, str(tmp_path / "l.txt")).collect()] == [(0, 0.1), (1, 0.3)]
    (tmp_path / "v1_frame_7_result.json").write_text('[{"call": "a", "band": 1},\n {"call": null, "band": 2}]')
    rows = files.json_rows(spark, str(tmp_path / "v1_frame_7_result.json"), "call string, band int", "frame_([0-9]+)").collect()
    assert [(r.call, r.band, r.key) for r in rows] == [("a", 1, "7"), (None, 2, "7")]


def test_frames_and_cached_strips(spark):
    assert [r.i for r in files.frames_at(spark.range(100).withColumnRenamed("id", "i"), 29.97).orderBy("i").collect()] == [0, 30, 60, 90]
    wanted = spark.createDataFrame([(1, 0, 100.0, 500.0), (2, 0, 100.0, 900.0), (3, 1, 0.0, 500.0)], "id int, band int, x0 double, x1 double")
    strips = spark.createDataFrame([("a", 0, 130.0, 570.0), ("b", 0, 150.0, 500.0), ("c", 0, 0.0, 830.0)], "key string, band int, c0 double, c1 double")
    assert {r.id: r.key for r in files.cached_strips(wanted, strips).collect()} == {1: "a", 2: "c", 3: None}


def test_appends_are_deltas(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    assert sinks.append_if_new(rows, path, "k") == 2 and sinks.append_if_new(rows, path, "k") == 0
    assert sinks.append_if_new(spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "k int, v string"), path, "k") == 1
    assert sorted(map(tuple, sinks.current(spark, path).collect()), key=str) == [(1, "a"), (2, "b"), (None, "n")]
    assert spark.read.parquet(f"{path}/v00000001-add").count() == 1
    assert sinks.replace_if_changed(spark.createDataFrame([(5, "q")], "k int, v string"), path, None)
    assert [tuple(r) for r in sinks.current(spark, path).collect()] == [(5, "q")]


def test_plain_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1-가1", None, True, "s1"), (None, "t", None, "s1"), ("2-나1", "u", False, "s2")], "call string, title string, mis boolean, session string")
    sinks.json_results(df, str(tmp_path / "j"))
    assert '"title":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    sinks.csv_with_mark(df.select("call", "title"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*")).read_bytes()[:3] == b"\xef\xbb\xbf"
    assert files.catalog_csv(spark, str(tmp_path / "c"), ("call", "title")).count() == 3
    sinks.report_bundle(df, str(tmp_path / "b"))
    got = {r.session: (r.rows, r.ok, r.mis) for r in spark.read.json(str(tmp_path / "b/summary")).collect()}
    assert got == {"s1": (2, 1, 1), "s2": (1, 1, 0)} and (tmp_path / "b/photos/session=s1").is_dir()
    made = []
    make = lambda: made.append(1) or df
    assert sinks.cached(spark, str(tmp_path / "k"), make).count() == sinks.cached(spark, str(tmp_path / "k"), make).count() == 3 and len(made) == 1
    assert sinks.cached(spark, str(tmp_path / "k"), make, refresh=True).count() == 3 and len(made) == 2
    assert "1-가1" in board.report_text({"books": df}) and "<td>1-가1</td>" in board.report_html({"books": df})


def test_streams_beyond_votes(spark, tmp_path):
    at = datetime.datetime(2026, 7, 1, 10)
    rows = [(at + datetime.timedelta(seconds=k), "s", k, k > 0 and k != 6, "x", k == 2, False) for k in range(10)]
    rows += [(at + datetime.timedelta(hours=3), "s", 0, False, "x", False, True), (at + datetime.timedelta(days=3), "t", 0, False, "y", False, False)]
    schema = "ts timestamp, session string, frame long, still boolean, call string, mis boolean, resolved boolean"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def result(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r.session, r.call): r.frames for r in result(sessions.votes(stream), "complete", "v2")}
    assert got == {("s", "x"): 10, ("t", "y"): 1}  # frame 0 comes again three hours later and votes once
    first = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).where("ts < '2026-07-01 11:00:00'")
    reused = {r.frame: r.reused for r in result(sessions.reused_boxes(first), "append", "r2")}
    assert reused == {0: False, 1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True, 9: True}
    kept = result(sessions.session_books(stream, "1 day"), "append", "b2")
    assert all(r.session == "s" for r in kept)
    ticks = result(sessions.reads_in_ticks(stream), "append", "t2")
    assert all(r.rows >= 1 for r in ticks)
    queue = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.id for r in sessions.waiting(queue, spark.createDataFrame([(2,), (2,)], "id int")).collect()] == [1, 3]
