"""Shelf queries against their oracles, and the order judgement against brute force and golden behaviour."""

from itertools import combinations

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__
from shelfspark.operators import sequence
from shelfspark.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ("catalog_clean", "kpi", "sessions_with_flags", "match_exact", "nearest_box", "bands", "capacity", "stable_votes", "photo_dedup", "lww_answers", "set_ops")


@given(st.lists(st.integers(0, 6), max_size=9))
def test_kept_is_longest(keys):
    kept = [k for k, ok in zip(keys, sequence.kept_in_order(keys)) if ok]
    assert kept == sorted(kept)
    longer = combinations(keys, len(kept) + 1)
    assert not any(list(c) == sorted(c) for c in longer)


def test_order_ties():
    assert sequence.kept_in_order([2, 1]) == [True, False]
    assert sequence.kept_in_order([3, 1, 2]) == [False, True, True]
    assert sequence.judged([1, None, 0, 2]) == [False, None, True, False]
    assert sequence.assign([[1], [1], [1], [0, 2]]) == 3


def test_judge_nulls(spark):
    rows = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 2, None), (1, 0, 3, 1), (1, 0, 4, 7)], "scan int, band int, pos int, key int")
    assert {r["pos"]: r["misplaced"] for r in sequence.judge(rows).collect()} == {1: False, 2: None, 3: True, 4: False}


@pytest.mark.parametrize("name", [*SOME, *sequence.QUERIES])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(repr(tuple(round(float(x), 5) if isinstance(x, float) else x for x in r)) for r in rows)
    expected = con.sql(__spark_entry__.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert plain(df.select(columns).collect()) == plain(expected)
