import random
from datetime import datetime

import pytest

from strataline.operators import references as R
from strataline.operators.edge_orphans import edge_orphans

A, B = datetime(2024, 1, 1), datetime(2024, 2, 1)
REFS = "id long, x long, y string, at timestamp, junk string"
GOAL = "x long, name string, at timestamp, junk int"


def orphans(spark, refs, goal, match, timed=True):
    r = spark.createDataFrame([(*t, "j") for t in refs], REFS)
    g = spark.createDataFrame([(*t, 1) for t in goal], GOAL)
    out = R.orphan_references(r, g, [("x", "x"), ("y", "name")], "id", match, "at" if timed else None, "at" if timed else None)
    return sorted(tuple(t) for t in out.collect())


GOALS = [(1, "a", A), (2, "b", B), (2, "b", B), (None, "n", A), (3, None, A)]


def test_simple_needs_all_columns(spark):
    refs = [(10, 1, "a", B), (11, 1, "b", B), (12, None, "zz", B), (13, 2, "b", A), (14, None, None, A)]
    assert orphans(spark, refs, GOALS, "simple") == [(11, "11", "missing"), (13, "11", "late")]


def test_full_rejects_some_nulls(spark):
    assert orphans(spark, [(10, 1, None, B), (11, None, None, B), (12, 1, "a", B)], GOALS, "full") == [(10, "10", "partial_null")]


def test_partial_matches_what_is_set(spark):
    refs = [(10, 1, None, B), (11, 9, None, B), (12, None, "b", B), (13, None, "q", B), (14, None, "n", B), (15, None, None, B)]
    assert orphans(spark, refs, GOALS, "partial") == [(11, "10", "missing"), (13, "01", "missing")]


def test_repeated_rows_and_earliest_arrival(spark):
    assert orphans(spark, [(13, 2, "b", A), (13, 2, "b", A)], GOALS, "simple") == [(13, "11", "late")]
    assert orphans(spark, [(13, 2, "b", A), (13, 2, "b", B)], GOALS, "simple") == [(13, "11", "late")]
    assert orphans(spark, [(13, 2, "b", A)], GOALS, "simple", timed=False) == []


def test_empty_tables(spark):
    assert orphans(spark, [], GOALS, "simple") == []
    assert orphans(spark, [(1, 1, "a", A)], [], "simple") == [(1, "11", "missing")]


def test_first_asks_the_first_column_that_is_set(spark):
    refs = [(10, 1, "zz", B), (11, 9, "a", B), (12, None, "a", B), (13, None, "zz", B), (14, None, None, B), (15, 2, "q", A), (16, 8, None, B), (16, 8, None, B), (17, None, "", B)]
    r = spark.createDataFrame([(*t, "j") for t in refs], REFS)
    g = spark.createDataFrame([(*t, 1) for t in GOALS], GOAL)
    gone = spark.createDataFrame([(8,), (8,), (1,), (None,)], "x int")
    for names, late in ((g, [(13, "01", "missing"), (17, "01", "missing")]), (g.limit(0), [(12, "01", "missing"), (13, "01", "missing"), (17, "01", "missing")])):
        out = R.orphan_references(r, [g, names], [("x", "x"), ("y", "name")], "id", "first", "at", "at", [gone, None])
        assert sorted(tuple(t) for t in out.collect()) == sorted([(11, "11", "missing"), (15, "11", "late"), (16, "10", "deleted"), *late])


@pytest.mark.parametrize("match", R.MATCHES[:3])
def test_random_tuples_against_brute_force(spark, match):
    r = random.Random(match)
    pick = lambda: (r.choice([None, 1, 2, 3, 4]), r.choice([None, "", "a", "b"]))
    refs = [(i, *pick(), B) for i in range(200)]
    goal = [(*pick(), A) for _ in range(6)]
    want = set()
    for i, x, y, _ in refs:
        mask = f"{int(x is not None)}{int(y is not None)}"
        held = any((x is None or x == a) and (y is None or y == b) for a, b, _ in goal)
        if mask == "11" or (match == "partial" and mask != "00"):
            want |= set() if held else {(i, mask, "missing")}
        elif match == "full" and mask != "00":
            want.add((i, mask, "partial_null"))
    assert set(orphans(spark, refs, goal, match)) == want


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        orphans(spark, [], [], "none")


def test_hot_failing_key_is_dealt_out_whole(spark):
    refs = spark.range(5000).selectExpr("id", "id % 3 as k")
    keys = spark.createDataFrame([(0, 1667), (1, 1667)], "k long, n_refs long")
    out = R.salted_join(refs, keys, ["k"], "id", rows_per_task=100)
    assert out.count() == 3334 and out.columns == ["k", "id"]
    assert out.select("id").distinct().count() == 3334


def test_edges_null_blank_and_states(spark):
    e = spark.createDataFrame(
        [
            (1, 5, None, "x", "call", A), (2, 6, 1, None, "call", A), (3, 7, 1, None, "call", A), (4, None, None, " \t", "call", A), (5, None, 2, " gone ", "call", A),
            (6, None, None, " known\n", "call", A), (7, None, None, "import x", "import", A), (7, None, None, "import x", "import", B), (8, 8, 1, None, "call", A), (8, 8, 1, None, "call", B), (None, 5, 5, "q", "call", A),
        ],
        "id long, dst_node_id long, src_file_id long, dst_name string, kind string, indexed_at timestamp",
    )
    n = spark.createDataFrame([(7, "known", A), (8, None, B), (7, "known ", B)], "id long, name string, indexed_at timestamp")
    f = spark.createDataFrame([(1, A)], "id long, indexed_at timestamp")
    p = spark.createDataFrame([("nodes", 6), ("nodes", 6), ("files", 5), (None, 5)], "table_name string, key_id long")
    got = sorted(tuple(r) for r in edge_orphans(e, n, f, p).select("edge_id", "field", "state").collect())
    assert got == [(1, "dst_node_id", "missing"), (2, "dst_node_id", "deleted"), (5, "dst_name", "missing"), (5, "src_file_id", "missing"), (8, "dst_node_id", "late")]
