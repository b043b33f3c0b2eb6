import random

from pyspark.sql import functions as F

from strataline.operators.graph import nearest, path_back, reach, shortest_cycles, strong_components
from strataline.operators.code_graph import explore, impact, neighbourhood, trace

E_DDL = "scope string, src long, dst long"


def edges(spark, pairs, scope="s"):
    return spark.createDataFrame([(scope, a, b) for a, b in pairs], E_DDL)


def test_ring_with_chord(spark):
    ring = [(i, (i + 1) % 8) for i in range(8)] + [(2, 0), (3, 3), (5, 40)]
    for limit in (100, 1):
        out = shortest_cycles(edges(spark, ring), "scope", limit).collect()
        assert [(r.scc, r.size, r.cycle) for r in out] == [(0, 8, [0, 1, 2])]
        parts = strong_components(edges(spark, ring), "scope", limit).collect()
        assert sorted((r.node, r.scc, r.size) for r in parts) == [(i, 0, 8) for i in range(8)]


def test_long_chain_has_no_cycle(spark):
    assert strong_components(edges(spark, [(i, i + 1) for i in range(8000)]), "scope").count() == 0


def test_components_against_closure(spark):
    r = random.Random(5)
    pairs = [(r.randint(1, 25), r.randint(1, 25)) for _ in range(40)]
    ways = {(a, b) for a, b in pairs if a != b}
    while more := {(a, d) for a, b in ways for c, d in ways if b == c} - ways:
        ways |= more
    want = sorted((a, min(min(b, a) for b in range(26) if (a, b) in ways and (b, a) in ways)) for a in range(26) if any((a, b) in ways and (b, a) in ways and a != b for b in range(26)))
    for limit in (1000, 1):
        assert sorted((x.node, x.scc) for x in strong_components(edges(spark, pairs), "scope", limit).collect()) == want


def test_shortest_cycle_is_least(spark):
    pairs = [(4, 7), (7, 4), (1, 2), (2, 3), (3, 1), (3, 4), (4, 1)]
    (row,) = shortest_cycles(edges(spark, pairs), "scope").collect()
    assert row.cycle == [4, 7]
    inside = {tuple(p) for p in pairs}
    assert all((a, b) in inside for a, b in zip(row.cycle, row.cycle[1:] + row.cycle[:1]))


def test_reach_and_path(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (4, 5), (None, 9), (5, None)])
    seeds = spark.createDataFrame([("s", 1), ("t", 1), ("s", None)], "scope string, node long")
    got = {(r.scope, r.node): (r.depth, r.parent) for r in reach(e, seeds, ["scope"]).collect()}
    assert got == {("s", 1): (0, None), ("t", 1): (0, None), ("s", 2): (1, 1), ("s", 3): (1, 1), ("s", 4): (2, 2), ("s", 5): (3, 4)}
    p = path_back(reach(e, seeds, ["scope"]), ["scope"], 5).collect()
    assert [(r.scope, list(r.path), r.hops) for r in p] == [("s", [1, 2, 4, 5], 3)]
    assert path_back(reach(e, seeds, ["scope"], 2), ["scope"], 5).count() == 0


def sample(spark):
    files = spark.createDataFrame([(1, "a.ts", "h", "typescript", "r")], "id long, path string, hash string, lang string, repo string")
    names = {1: "alpha", 2: "beta", 3: "gamma", 4: "helper", 5: "render"}
    nodes = spark.createDataFrame([(i, 1, n, "function", i) for i, n in names.items()], "id long, file_id long, name string, kind string, start_line int")
    calls = [(1, "beta"), (2, "gamma"), (1, "helper"), (5, "alpha"), (3, "gamma"), (2, None)]
    ids = {n: i for i, n in names.items()}
    edges = spark.createDataFrame([(k, s, 1, d, ids.get(d), "call", k) for k, (s, d) in enumerate(calls)], "id long, src_node_id long, src_file_id long, dst_name string, target long, kind string, line int")
    return edges, nodes, files


def test_trace_and_impact(spark):
    e, n, f = sample(spark)
    one = lambda a, b: [(r.path, r.hops) for r in trace(e, n, f, a, b).collect()]
    assert one("alpha", "gamma") == [("alpha -> beta -> gamma", 2)]
    assert one("alpha", "alpha") == [("alpha", 0)]
    assert one("gamma", "alpha") == [(None, -1)]
    got = {r.name: r.depth for r in impact(e, n, f, "gamma").collect()}
    assert got == {"beta": 1, "gamma": 1, "alpha": 2, "render": 3}
    assert {r.name for r in impact(e, n, f, "gamma", 1).collect()} == {"beta", "gamma"}
    assert impact(e, n, f, "nothing").count() == 0


def test_neighbourhood_degree(spark):
    e, n, f = sample(spark)
    pairs = e.filter("target is not null").selectExpr("src_node_id as s", "target as t")
    got = {r.name: (r.deg, r.depth) for r in neighbourhood(n, f, pairs, "gamma", 2).collect()}
    assert got == {"gamma": (1, 0), "beta": (2, 1), "alpha": (3, 2)}


def test_explore(spark):
    n = spark.createDataFrame([(1, 1, "go", "function", 3, 4, 9), (2, 1, "stop", "class", 7, 0, 3), (3, 2, "go", "variable", 1, 5, 2), (4, 1, None, "class", 1, 0, 1)], "id long, file_id long, name string, kind string, start_line int, start_byte int, end_byte int").withColumn("signature", F.lit("s"))
    f = spark.createDataFrame([(1, "a.py", "r"), (2, "b.py", "q")], "id long, path string, repo string")
    e = spark.createDataFrame([(1, 1, 1, "stop", 2, "call", 5, 2), (2, 1, 1, "gone", None, "call", 4, None), (3, 2, 1, "go", 1, "call", 8, 1), (4, 2, 1, "go", 1, "call", 9, 1)], "id long, src_node_id long, src_file_id long, dst_name string, dst_node_id long, kind string, line int, target long")
    text = spark.createDataFrame([(1, "é = go()\nx"), (1, None)], "file_id long, text string").limit(1)
    got = explore(n, f, e.withColumn("repo", F.lit("r")), "go", text).orderBy("rank").collect()
    assert [(r.id, r.exact, r.source) for r in got] == [(1, True, "go()\n"), (3, True, None)]
    assert [tuple(c) for c in got[0].callees] == [("gone", 4, None), ("stop", 5, "a.py")] and [tuple(c) for c in got[0].callers] == [("stop", "a.py", 7)]
    near = explore(n, f, e.withColumn("repo", F.lit("r")), "sto").collect()
    assert [(r.name, r.exact, r.callees) for r in near] == [("stop", False, None)]
    assert explore(n.limit(0), f, e.withColumn("repo", F.lit("r")), "go").count() == 0


def test_nearest_goal_of_each_origin(spark):
    r = random.Random(4)
    pairs = {(r.randint(1, 30), r.randint(1, 30)) for _ in range(45)}
    edges = spark.createDataFrame([("s", a, b) for a, b in pairs], "repo string, src long, dst long")
    origins, goals = set(range(1, 18)), {3, 9, 20, 25, 29}
    want = set()
    for o in origins:
        seen, level, d = {o}, [o], 0
        while level:
            d += 1
            level = sorted({b for a, b in pairs if a in level} - seen)
            seen |= set(level)
            if goals & set(level):
                want.add(("s", o, min(goals & set(level)), d))
                break
    frame = lambda ids: spark.createDataFrame([("s", i) for i in ids], "repo string, node long")
    assert {tuple(x) for x in nearest(edges, frame(origins), frame(goals), ["repo"]).collect()} == want
