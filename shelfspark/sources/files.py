"""Readers of the shelf file formats, each with a declared schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "struct<call:string,title:string,mis:boolean,resolved:boolean,band:int,how:string>"
#: Both generations of inspection reports: one photo's books, or items with a file and books each.
REPORT = f"struct<date:string,device:string,books:array<{BOOK}>,items:array<struct<file:string,time:string,books:array<{BOOK}>>>>"
ZIP_MEMBERS = "zip string, member string, body string"


def catalog_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("call_number", "title")) -> DataFrame:
    """A CSV catalog with a header, all columns text; a byte order mark is dropped. Raises ValueError if a required column is missing."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(file, gt, tag) of training lines."""
    return spark.read.schema("file string, gt string, tag string").option("sep", "\t").csv(path)


def json_rows(spark: SparkSession, path: str, schema: str, key_pattern: str) -> DataFrame:
    """Rows of JSON arrays in many files, with ``key`` taken from the file name by the pattern's first group."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("key", F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1))


def boxes_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, cx, cy, w, h) of label files with five numbers a line; other lines are left out."""
    parts = F.split(F.trim("value"), "\\s+")
    df = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), parts.alias("p")).where(F.size("p") == 5)
    return df.select("file", F.expr("try_cast(p[0] as int)").alias("cls"), *(F.expr(f"try_cast(p[{k + 1}] as double)").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))))


def feed_xml(spark: SparkSession, path: str, schema: str, row_tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".json", prefix: str = "") -> DataFrame:
    """(zip, member, body) of the text members of zip files; files whose name lacks the prefix are not opened. A broken zip has no rows."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(name, m, z.read(m).decode("utf-8-sig", "replace")) for m in sorted(z.namelist()) if m.endswith(suffix)]
                except zipfile.BadZipFile:
                    rows = []
                yield pd.DataFrame(rows, columns=["zip", "member", "body"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.where(F.col("name").startswith(prefix)).mapInPandas(members, ZIP_MEMBERS)


def reports(members: DataFrame) -> DataFrame:
    """(zip, photo, date, device, books): one row a photo from reports of both generations; unreadable ones are left out.

    A report with ``books`` is one photo named '?'. An item without a time takes the report's date.
    """
    parsed = members.select("zip", F.from_json("body", REPORT).alias("r")).where("r.books is not null or r.items is not null")
    single = parsed.where("r.books is not null").select("zip", F.lit("?").alias("photo"), "r.date", "r.device", "r.books")
    many = parsed.where("r.books is null").select("zip", "r.date", "r.device", F.explode("r.items").alias("i"))
    many = many.select("zip", F.coalesce("i.file", F.lit("?")).alias("photo"), F.coalesce("i.time", "date").alias("date"), "device", F.coalesce("i.books", F.from_json(F.lit("[]"), f"array<{BOOK}>")).alias("books"))
    return single.unionByName(many)


def distinct_photos(photos: DataFrame) -> DataFrame:
    """One photo for each sequence of calls, nulls included: that of the first zip and photo by name; adds ``copies``."""
    key = F.xxhash64(F.transform("books.call", lambda c: F.coalesce(c, F.lit("\0"))))
    first = F.min_by(F.struct(*photos.columns), F.struct("zip", "photo")).alias("p")
    return photos.withColumn("_key", key).groupBy("_key").agg(first, F.count("*").alias("copies")).select("p.*", "copies")


LOANS = "struct<response:struct<docs:array<struct<doc:struct<isbn13:string,bookname:string,authors:string,loan_count:string,ranking:string,class_no:string>>>>>"


def loans_json(spark: SparkSession, path: str) -> DataFrame:
    """(kdc, rank, isbn13, title, author, loans) from landed answers of the loans service, a file for each class ``kdc_N.json``; a failed or empty answer has no rows."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "kdc_([0-9])", 1).alias("kdc"), F.from_json("value", LOANS).alias("r"))
    doc = body.select(F.col("kdc").try_cast("int").alias("kdc"), F.explode("r.response.docs.doc").alias("d"))
    isbn = F.regexp_replace("d.isbn13", "[^0-9]", "")
    return doc.select("kdc", F.col("d.ranking").try_cast("int").alias("rank"), F.when(F.length(isbn) == 13, isbn).alias("isbn13"), F.col("d.bookname").alias("title"), F.col("d.authors").alias("author"), F.col("d.loan_count").try_cast("int").alias("loans"))


def picks_xml(spark: SparkSession, path: str) -> DataFrame:
    """(item, isbn13, title, author, note, ym, cat) of the librarians' picks: a row for each ISBN of an item's list, notes as plain text."""
    from ..functions.text import html_text

    rows = feed_xml(spark, path, "recomtitle string, recomauthor string, recomisbn string, recomcontens string, recomYear string, recomMonth string, drCodeName string")
    isbns = F.array_distinct(F.filter(F.transform(F.split(F.trim("recomisbn"), "\\s+"), lambda i: F.regexp_replace(i, "[^0-9]", "")), lambda i: F.length(i) == 13))
    item = F.xxhash64("recomtitle", "recomauthor", "recomisbn")
    return rows.select(item.alias("item"), F.explode(isbns).alias("isbn13"), F.col("recomtitle").alias("title"), F.col("recomauthor").alias("author"), html_text("recomcontens").alias("note"), F.concat("recomYear", F.lpad("recomMonth", 2, "0")).alias("ym"), F.col("drCodeName").alias("cat"))


def log_blocks(spark: SparkSession, path: str, marker: str, pattern: str, names: tuple[str, ...] = ("matched", "total")) -> DataFrame:
    """(file, block, ...) of logs that a marker cuts into blocks: the pattern's groups as numbers; blocks without a match are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", marker)).alias("block", "body"))
    hit = text.where(F.regexp_extract("body", pattern, 0) != "")
    return hit.select("file", "block", *(F.regexp_extract("body", pattern, k + 1).try_cast("long").alias(n) for k, n in enumerate(names)))


def raw_catalog(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The library system's export as CSV, its columns renamed by ``columns`` (target name: header); a missing one raises ValueError."""
    df = catalog_csv(spark, path, tuple(columns.values()))
    return df.select(*(F.trim(F.col(f"`{header}`")).alias(name) for name, header in columns.items()))


def frames_at(frames: DataFrame, fps: float, index: str = "i") -> DataFrame:
    """One frame a second of a video: every one whose index is a multiple of the rounded rate."""
    return frames.where(F.col(index) % max(1, round(fps)) == 0)


def cached_strips(wanted: DataFrame, strips: DataFrame, end: float = 80, start: float = 40) -> DataFrame:
    """Each wanted strip (id, band, x0, x1) with the first cached one (key, band, c0, c1) of its band that ends within ``end`` of it and does not begin more than ``start`` behind it, else null."""
    # A strip that ends within reach lies in the cell of its end or in a neighbouring one.
    cell = lambda x: F.floor(F.col(x) / end)
    spread = wanted.withColumn("_cell", F.explode(F.array(cell("x1") - 1, cell("x1"), cell("x1") + 1)))
    near = spread.join(strips.withColumn("_cell", cell("c1")), ["band", "_cell"]).where((F.abs(F.col("c1") - F.col("x1")) <= end) & (F.col("c0") <= F.col("x0") + start))
    first = near.groupBy("id").agg(F.min("key").alias("key"))
    return wanted.join(first, "id", "left")
