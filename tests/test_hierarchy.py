import random

import pytest
from pyspark.sql import functions as F

from strataline.operators.hierarchy import ancestors, descendants, hierarchy


def brute(rows):
    parent, grp = {}, {}
    for i, p, g in rows:
        if i is not None and i not in parent:
            parent[i], grp[i] = p, g
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    out = {}
    for i in parent:
        path, cur, cross, state = [i], i, False, None
        while state is None:
            up = parent[cur]
            if up is None or up not in parent:
                state = ("other_file" if cross else "ok") if up is None else "broken"
            elif up == i:
                state = "on_cycle"
            elif up in path:
                state = "under_cycle"
            else:
                cross |= grp[up] != grp[cur]
                path.append(up)
                cur = up
        out[i] = (state, path[::-1] if "cycle" not in state else None)
    size, pre = {}, {}

    def walk(i, at):
        pre[i] = at
        n = 0
        for k in sorted(kids.get(i, [])):
            walk(k, at + 1 + n)
            n += size[k] + 1
        size[i] = n

    for i, (state, path) in out.items():
        if path == [i]:
            walk(i, 0)
    return {i: (s, p, len(p) - 1 if p else None, p[0] if p else None, pre.get(i) if p else None, size.get(i) if p else None) for i, (s, p) in out.items()}


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, parent_id long, file_id long, root string")
    return {r.id: (r.state, r.path, r.depth, r.root, r.pre, r.size) for r in hierarchy(df, group="file_id", **options).collect()}


def forest(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(1, n):
        kind = r.random()
        p = None if kind < 0.15 else 9000 + i if kind < 0.2 else r.randint(1, n - 1) if kind < 0.35 else r.randint(max(1, i - 8), max(1, i - 1))
        rows.append((i, p, r.choice([1, 1, 1, 2, None])))
    rows += rows[:5] + [(None, 3, 1)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = forest(seed)
        assert run(spark, rows) == brute(rows)


def test_large_trees_by_levels(spark):
    rows = forest(3, 60)
    assert run(spark, rows, tree_rows=3) == brute(rows)


def test_deep_chain_wide_node_self_loop(spark):
    rows = [(i, i - 1 if i > 1 else None, 1) for i in range(1, 301)] + [(1000 + i, 500, 1) for i in range(300)] + [(500, None, 1), (600, 600, 1), (601, 600, 1), (700, 701, 1), (701, 700, 1)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, None, "a")], "id long, parent_id long, path string")
    assert [tuple(r) for r in hierarchy(df, with_path=False).collect()] == [(1, 1, 0, 0, 0, "ok")]


@pytest.mark.parametrize("tree_rows", [3, 1000])
def test_descendants_and_ancestors(spark, tree_rows):
    rows = forest(5, 80)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, parent_id long, file_id long, root string")
    tree = hierarchy(df, group="file_id", with_path=False, tree_rows=tree_rows)
    want = {(a, i, len(p) - 1 - k) for i, (_, p, *_) in brute(rows).items() if p for k, a in enumerate(p[:-1])}
    assert {tuple(r) for r in descendants(tree).collect()} == want
    some = spark.createDataFrame([(7,), (20,), (7,), (None,)], "id long")
    assert sorted(tuple(r) for r in ancestors(tree, some).collect()) == sorted((i, a, n) for a, i, n in want if i in (7, 20))
    assert descendants(tree.limit(0)).count() == 0


def test_contraction_of_any_rows_together(spark, monkeypatch):
    monkeypatch.setattr("strataline.operators.hierarchy.TREE_ROWS", 7)
    rows = forest(8, 90)
    assert run(spark, rows, tree_rows=1000) == brute(rows)


def test_chain_of_many_links_takes_few_jobs(spark):
    n = 3_000
    df = spark.range(n).selectExpr("id", "nullif(id, 0) - 1 as parent_id").union(spark.range(n, 2 * n).selectExpr("id", "5L"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        tree = hierarchy(df, with_path=False, tree_rows=1000)
        row = tree.agg(F.sum("pre"), F.sum("depth"), F.sum("size"), F.max("depth"), F.expr("count_if(state = 'ok')")).first()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # node 5 has the chain's next node first, then its n other children
    depths = n * (n - 1) // 2 + n * 6
    sizes = sum(n - 1 - i + (n if i <= 5 else 0) for i in range(n))
    assert tuple(row) == (2 * n * (2 * n - 1) // 2, depths, sizes, n - 1, 2 * n)
    assert 0 < len(jobs.getJobIdsForGroup("chain")) < 40 * n.bit_length()
