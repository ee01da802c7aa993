"""The order-dependent operators against hand-made tables and brute force."""

import random
from itertools import combinations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from shelfspark.operators import folds, sequence
from shelfspark.plans import places


def most_assigned(candidates, repeat):
    """The greatest number of spines that can be assigned, by trying everything."""
    best = 0
    for choice in product(*([None, *c] for c in candidates)):
        got = [(i, v) for i, v in enumerate(choice) if v is not None]
        values = [v for _, v in got]
        fine = values == sorted(values) and all(values.count(v) <= 2 for v in values)
        if repeat is not None:
            fine = fine and all(repeat[j] for (_, v), (j, w) in zip(got, got[1:]) if v == w)
        best = max(best, len(got) if fine else 0)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=2, unique=True), max_size=6), st.data())
def test_assignment_is_greatest(candidates, data):
    repeat = data.draw(st.one_of(st.none(), st.lists(st.booleans(), min_size=len(candidates), max_size=len(candidates))))
    got = folds.assigned(candidates, repeat)
    assert all(v is None or v in c for v, c in zip(got, candidates))
    values = [v for v in got if v is not None]
    assert values == sorted(values) and all(values.count(v) <= 2 for v in values)
    assert len(values) == most_assigned(candidates, repeat)


def test_assignment_of_nothing():
    assert folds.assigned([]) == [] and folds.assigned([None, []]) == [None, None]
    assert folds.assigned([[3], [1], [2]]) == [None, 1, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=7, unique=True))
def test_chain_is_longest(pairs):
    got = folds.increasing_chain(pairs)
    grows = lambda c: all(a < x and b < y for (a, b), (x, y) in zip(c, c[1:]))
    assert grows(got) and set(got) <= set(pairs)
    assert not any(grows(sorted(c)) for c in combinations(pairs, len(got) + 1))


def test_unread_boxes():
    """One confirmed and four unread boxes leave two books; a row without a box is passed over."""
    boxes = [(0, 0, 10, 10), (2, 0, 12, 10), (30, 0, 40, 10), (33, 0, 43, 10), (60, 0, 70, 10)]
    call = ["005.1-가1", None, None, None, None]
    assert folds.connected_unread(call, boxes) == 2 and sum(folds.unread_left(call, boxes)) == 2
    merged = [(0, 0, 10, 10), None, (2, 0, 12, 10), (60, 0, 70, 10)]
    assert folds.connected_unread(["a", "b", None, None], merged) == 1
    assert folds.connected_unread([], []) == 0


def test_rows_boxes_and_doubles():
    assert folds.row_groups([10, 12, 60, 13, 58], [20, 20, 20, 20, 20]) == [0, 0, 1, 0, 1]
    assert folds.overlap_merge([(0, 0, 10, 10), (3, 5, 12, 15), (30, 0, 40, 10)]) == [(0, 0, 12, 15), (30, 0, 40, 10)]
    assert folds.adjacent_kept([0, 50, 300, 310], ["a", "a", "a", None], [0.5, 0.9, 0.1, 1]) == [False, True, True, True]
    assert folds.near_duplicates_cleared([0, 10, 500, 12], [20, 20, 20, 20], ["a", "a", "a", None], [0.9, 0.5, 0.1, 1]) == [True, False, True, False]
    assert folds.greedy_matches([(0, 0, 10, 10), (1, 0, 11, 10), (50, 0, 60, 10)], [(0, 0, 10, 10)]) == [0, None, None]
    assert folds.greedy_matches([(0, 0, 1, 1)], []) == [None]


def test_clusters_and_ghosts():
    is_class, has_author = (lambda t: t.isdigit()), (lambda t: t.startswith("가"))
    tokens = [(0, 0, "813"), (2, 9, "가1"), (28, 0, "911"), (30, 9, "가2"), (100, 0, "가3")]
    assert [[t[2] for t in c] for c in folds.resplit(tokens, 30, is_class, has_author)] == [["813", "가1"], ["911", "가2"], ["가3"]]
    alone = [(0, 0, "813"), (2, 9, "가1"), (28, 0, "911")]
    assert [[t[2] for t in c] for c in folds.resplit(alone, 30, is_class, has_author)] == [["813", "가1", "911"]]
    assert [len(p) for p in folds.split_at([(0, 0, "a"), (50, 0, "b"), (60, 0, "c")], [0, 55])] == [1, 2]
    assert folds.ghost_slots([0, 100, 200], [0, 210], 60) == [100] and folds.ghost_slots([5], [], 60) == [5]


def test_alignment():
    truth = [("a", 0), ("x", 10), ("b", 20), ("c", 30), ("y", 40), ("z", 50), ("d", 60)]
    target = [("a", 0), (None, 11), ("b", 20), ("c", 30), (None, 49), ("d", 60)]
    assert folds.aligned(truth, target) == [(1, 1), (5, 4)]
    assert folds.aligned(truth[:3], target[:3]) == []


def test_reason_and_find(spark):
    """The shelf 1, 5, 2, 3: the second book is out of place, stands between its neighbours and belongs behind the last."""
    rows = spark.createDataFrame([(1, 0, 1, "005.1-가1", 1), (1, 0, 2, "005.5-나2", 5), (1, 0, 3, "005.2-다3", 2), (1, 0, 4, "005.3-라4", 3)], "scan int, band int, pos int, call string, key int")
    r = places.reasons(sequence.judge(rows)).collect()
    assert [(x["call"], x["left_call"], x["right_call"], x["belongs_after"], x["belongs_before"]) for x in r] == [("005.5-나2", "005.1-가1", "005.2-다3", "005.3-라4", None)]
    walks = {1: [10, 20, 30], 2: [10, None, 30], 3: [10, None, None, 30], 4: [1, 2, 3]}
    rows = spark.createDataFrame([(s, 0, k, p, 20) for s, w in walks.items() for k, p in enumerate(w)], "scan int, band int, pos int, place int, target int")
    got = sorted((x["scan"], x["pos"], x["chance"]) for x in places.find_chances(rows).where("chance is not null").collect())
    assert got == [(1, 1, 98), (2, 1, 95), (3, 1, 45), (3, 2, 45)]


def test_places_are_a_sort(spark):
    keys = [random.Random(4).randrange(50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "ord long, key int").repartition(7)
    got = {r["ord"]: r["place"] for r in sequence.placed(df, ["key", "ord"]).collect()}
    assert got == {o: i + 1 for i, (k, o) in enumerate(sorted((k, o) for o, k in enumerate(keys)))}
    ranks = {r["key"]: (r["first"], r["last"]) for r in sequence.ranked_keys(df.select("key")).collect()}
    assert all(last - first + 1 == keys.count(k) and first == 1 + sum(x < k for x in keys) for k, (first, last) in ranks.items())


def test_no_single_task_sort_of_the_catalog(spark):
    """Places don't bring the catalog to one task: a plan has such an exchange only over the counts of partitions."""
    plan = __spark_entry__.queries()["misplaced_books"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "BroadcastNestedLoopJoin" not in plan


def test_places_do_not_depend_on_how_rows_are_dealt(spark):
    """Partition ids differ between the branches of a plan, so no number may come from them; nulls, structs and arrays are keys too."""
    df = spark.createDataFrame([(o, ([o * 7 % 300], None if o % 3 else str(o % 11))) for o in range(2000)], "ord long, key struct<a: array<int>, b: string>")
    out = sequence.placed(df, ["key", "ord"])
    assert "SPARK_PARTITION_ID" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(out.collect(), key=lambda r: (r["key"]["a"], r["key"]["b"] or "", r["ord"]))
    assert [r["place"] for r in rows] == list(range(1, 2001))


def test_split_does_not_depend_on_how_rows_are_dealt(spark):
    out = __spark_entry__.queries()["group_split"](spark, SF)
    assert "SPARK_PARTITION_ID" not in out._jdf.queryExecution().executedPlan().toString()


SF = "/root/testdata/sf0.001"
REGISTERED = ["assign_count", "merged_boxes", "without_doubles", "near_duplicates_cleared", "greedy_iou", "unread_books", "x_clusters", "loo_inference", "distance", "find_prob", "normal_forms", "shelf_order", "other_orders", "token_search", "match_call_exact", "containment_unique", "prefix_unique", "group_split", "tiled_boxes", "adoption", "read_rates"]


@pytest.mark.parametrize("name", REGISTERED)
def test_registered_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "embeddings", "pages", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(repr(tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    expected = con.sql(__spark_entry__.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert plain(df.select(columns).collect()) == plain(expected)
