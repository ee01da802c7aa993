"""Writers that look at what is there before they write.

A table is a folder of versions ``v00000000``, ``v00000001`` and so on; the last is the present one and the
others are its backups. A version named ``v00000002-add`` holds rows that are added to the ones before. Nothing
is overwritten, so a lost job leaves the present version as it was: a version counts only with the marker of a
finished write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(f"{path}/{n}" for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version with the rows added since, or None."""
    known = _versions(spark, path)
    whole = [k for k, v in enumerate(known) if not v.endswith("-add")]
    return spark.read.parquet(*known[whole[-1] :]) if whole else None


def fingerprint(df: DataFrame) -> tuple:
    """Row count and two order-free sums of row hashes, with the schema; repeated rows count."""
    cols = sorted(df.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in cols))
    sums = [F.sum(F.xxhash64(F.lit(seed), F.to_json(row, {"ignoreNullFields": "false"})).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(df.agg(F.count("*"), *sums).first()) + (df.select(*(f"`{c}`" for c in cols)).schema.simpleString(),)


def _write(df: DataFrame, path: str, added: bool = False) -> None:
    known = _versions(df.sparkSession, path)
    number = int(known[-1].rsplit("/v", 1)[1][:8]) + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/v{number:08d}{'-add' if added else ''}")


def replace_if_changed(df: DataFrame, path: str, max_loss: float | None = 0.05) -> bool:
    """Writes a new version if the rows differ from the present ones; says whether it did.

    Raises ValueError if more than ``max_loss`` of the present row count would go; None switches that off.
    """
    present = current(df.sparkSession, path)
    if present is not None:
        old, new = fingerprint(present), fingerprint(df)
        if old == new:
            return False
        if max_loss is not None and new[0] < old[0] * (1 - max_loss):
            raise ValueError(f"{old[0]} rows would become {new[0]}")
    _write(df, path)
    return True


def append_if_new(df: DataFrame, path: str, key: str) -> int:
    """Adds the rows whose key the table lacks, one for each key (the least row by value), and says how many; a null is a key like others.

    Only the new rows are written.
    """
    one = df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("r")).select("r.*")
    present = current(df.sparkSession, path)
    if present is None:
        _write(one, path)
        return one.count()
    known = present.select(F.col(key).alias("_known")).distinct()
    new = one.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").select(present.columns)
    n = new.count()
    if n:
        _write(new, path, added=True)
    return n


def union_set(df: DataFrame, path: str) -> None:
    """The table becomes the distinct rows of itself and ``df``."""
    present = current(df.sparkSession, path)
    _write(df.distinct() if present is None else present.unionByName(df).distinct(), path)


def json_results(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields included."""
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV files whose header begins with a byte order mark, as spreadsheets like it; ``files.catalog_csv`` drops it again."""
    first, *rest = df.columns
    df.toDF(f"\ufeff{first}", *rest).write.option("header", True).mode("errorifexists").csv(path)


def load_tables(photos: DataFrame, books: DataFrame, database: str = "default") -> None:
    """The dashboard's two tables, replaced as wholes."""
    for name, df in (("photos", photos), ("books", books)):
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def report_bundle(rows: DataFrame, path: str, session: str = "session") -> None:
    """Rows in a folder for each session, and a summary of all of them beside: rows, read and misplaced ones."""
    rows.write.partitionBy(session).mode("errorifexists").json(f"{path}/photos")
    summary = rows.groupBy(session).agg(F.count("*").alias("rows"), F.count("call").alias("ok"), F.count_if(F.coalesce(F.col("mis"), F.lit(False))).alias("mis"))
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")  # a row for each session


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """What the table holds, or what ``make`` gives, written first; ``refresh`` makes it anew."""
    present = None if refresh else current(spark, path)
    if present is None:
        _write(make(), path)
        present = current(spark, path)
    return present
