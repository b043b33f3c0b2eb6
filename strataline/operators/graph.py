"""Traversal of graphs held as edge tables: breadth-first reach, paths, components, cycles.

Reach runs as a loop of joins: the frontier is joined with the edges, known nodes are taken
out, and each level is written before the next. Strongly connected parts are found per scope
(a repository): scopes with few edges go whole to a task, where an iterative depth-first
search does the work; larger ones are narrowed by trimming and by colouring with joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import materialize

#: Edges of a scope that one task may hold.
SCOPE_EDGES = 500_000


def reach(edges: DataFrame, seeds: DataFrame, scope: list[str], max_depth: int | None = None, origin: list[str] | None = None, until: DataFrame | None = None) -> DataFrame:
    """scope..., origin..., node, depth, parent: nodes within max_depth of the seeds, seeds at 0.

    edges: scope..., src, dst. seeds: scope..., origin..., node. Among several parents of the
    first level the least is kept. Null ends lead nowhere. A search (scope..., origin...) that
    meets a node of ``until`` (scope..., node) after its seeds goes no further than that level.
    A job runs for each level.
    """
    key = [*scope, *(origin or [])]
    edges = materialize(edges.select(*scope, "src", "dst").dropna().distinct(), "edges")
    first = seeds.select(*key, "node").dropna(subset=["node"]).distinct()
    level = materialize(first.select(*key, "node", F.lit(0).alias("depth"), F.lit(None).cast(dict(first.dtypes)["node"]).alias("parent")), "level")
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.select(*key, F.col("node").alias("src")).join(edges, [*scope, "src"]).groupBy(*key, F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        known = reduce(DataFrame.unionByName, [x.select(*key, "node") for x in levels])
        level = materialize(step.join(known, [*key, "node"], "left_anti").select(*key, "node", F.lit(depth).alias("depth"), "parent"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        if until is not None:
            met = level.join(until, [*scope, "node"], "left_semi")
            if not met.isEmpty():
                level = level.join(met.select(*key).distinct(), key, "left_anti") if key else level.limit(0)
    return reduce(DataFrame.unionByName, levels)


def nearest(edges: DataFrame, origins: DataFrame, goals: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., origin, hit, depth: for each of ``origins`` (scope..., node) the nearest other node of ``goals``, of equally near ones the least.

    The search goes back from the goals and keeps one row for each node, whatever the number of
    origins. Only origins that are goals themselves, which have to find another one, search forward.
    """
    edges = materialize(edges.select(*scope, "src", "dst").dropna().distinct(), "edges")
    goals, origins = materialize(goals.select(*scope, "node").dropna().distinct(), "goals"), origins.select(*scope, "node").dropna().distinct()
    level = goals.withColumn("hit", F.col("node")).withColumn("depth", F.lit(0))
    levels, depth = [level], 0
    while True:
        depth += 1
        back = edges.join(level.select(*scope, F.col("node").alias("dst"), "hit"), [*scope, "dst"]).groupBy(*scope, F.col("src").alias("node")).agg(F.min("hit").alias("hit"))
        known = reduce(DataFrame.unionByName, [x.select(*scope, "node") for x in levels])
        level = materialize(back.join(known, [*scope, "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        levels.append(level)
    key = [*scope, "node"]
    found = origins.join(reduce(DataFrame.unionByName, levels).filter("depth > 0"), key).select(*scope, F.col("node").alias("origin"), "hit", "depth")
    both = materialize(origins.join(goals, key, "left_semi"), "both")
    if both.isEmpty():
        return found
    far = reach(edges, both.select(*scope, F.col("node").alias("origin"), "node"), scope, None, ["origin"], goals)
    return found.unionByName(first_targets(far, goals, scope))


def first_targets(reached: DataFrame, hits: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., origin, hit, depth: for each origin the least node of ``hits`` (scope..., node) at the least depth above 0."""
    ok = reached.filter("depth > 0").join(hits, [*scope, "node"], "left_semi")
    best = ok.groupBy(*scope, "origin").agg(F.min(F.struct("depth", "node")).alias("b"))
    return best.select(*scope, "origin", F.col("b.node").alias("hit"), F.col("b.depth").alias("depth"))


def path_back(reached: DataFrame, scope: list[str], target: str) -> DataFrame:
    """scope..., path (array), hops: the way from a seed to ``target`` along parents, one row per scope that has it."""
    at = materialize(reached.filter(F.col("node") == target).select(*scope, F.array("node").alias("path"), "depth", "parent"), "path")
    done = [at.filter("parent is null")]
    left = at.filter("parent is not null")
    for _ in range(at.agg(F.max("depth")).first()[0] or 0):
        up = reached.select(*scope, F.col("node").alias("parent"), F.col("parent").alias("next"))
        left = left.join(up, [*scope, "parent"]).select(*scope, F.array_prepend("path", F.col("parent")).alias("path"), "depth", F.col("next").alias("parent"))
        left = materialize(left, "path")
        done.append(left.filter("parent is null"))
        left = left.filter("parent is not null")
    return reduce(DataFrame.unionByName, done).select(*scope, "path", F.col("depth").alias("hops"))


def _components(adj: dict, order: list) -> list[list]:
    """Strongly connected components, by an iterative depth-first search with an index stack."""
    number: dict = {}
    low: dict = {}
    stack: list = []
    open_ = set()
    out = []
    for start in order:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack.append(start)
        open_.add(start)
        work = [(start, iter(adj.get(start, ())))]
        while work:
            node, it = work[-1]
            for nxt in it:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    stack.append(nxt)
                    open_.add(nxt)
                    work.append((nxt, iter(adj.get(nxt, ()))))
                    break
                if nxt in open_:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        open_.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    out.append(sorted(part))
    return out


def _least_cycle(part: list, adj: dict) -> list:
    """The shortest cycle inside a component; of equally short ones the least, read from its least node."""
    inside = set(part)
    best: list | None = None
    for start in part:
        parent, level, found, length = {start: None}, [start], None, 0
        # no further than the best cycle so far
        while level and found is None and (best is None or length < len(best)):
            length += 1
            nxt = []
            for node in sorted(level):
                for n in sorted(x for x in adj.get(node, ()) if x in inside):
                    if n == start:
                        found = node if found is None else found
                    elif n not in parent:
                        parent[n] = node
                        nxt.append(n)
                if found is not None:
                    break
            level = nxt
        if found is None:
            continue
        path = [found]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        if best is None or len(path) < len(best) or (len(path) == len(best) and path < best):
            best = path
    return best or []


def _scoped(work, schema: pa.Schema):
    """Apply work(scope, edges) to each scope of sorted batches of (scope, src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edges = None, []
        for b in batches:
            for s, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != now and edges:
                    yield from (pa.RecordBatch.from_pylist(r, schema=schema) for r in [work(now, edges)] if r)
                    edges = []
                now = s
                edges.append((x, y))
        if edges:
            yield from (pa.RecordBatch.from_pylist(r, schema=schema) for r in [work(now, edges)] if r)

    return run


def _adjacency(edges) -> tuple[dict, list]:
    adj = defaultdict(set)
    nodes = set()
    for x, y in edges:
        nodes |= {x, y}
        if x != y:
            adj[x].add(y)
    return adj, sorted(nodes)


def _find_parts(scope, edges):
    adj, nodes = _adjacency(edges)
    return [{"scope": scope, "node": n, "scc": p[0], "size": len(p)} for p in _components(adj, nodes) if len(p) > 1 for n in p]


def _find_cycles(scope, edges):
    adj, nodes = _adjacency(edges)
    return [{"scope": scope, "scc": p[0], "size": len(p), "cycle": _least_cycle(p, adj)} for p in _components(adj, nodes) if len(p) > 1]


def _core(edges: DataFrame) -> DataFrame:
    """Edges without those that are surely on no cycle: ends that lack an edge in or out are trimmed until none is left."""
    left = materialize(edges, "core")
    n = left.count()
    while n:
        ins = left.select("scope", F.col("dst").alias("src")).distinct()
        outs = left.select("scope", F.col("src").alias("dst")).distinct()
        kept = materialize(left.join(ins, ["scope", "src"], "left_semi").join(outs, ["scope", "dst"], "left_semi").select("scope", "src", "dst"), "core")
        m = kept.count()
        left = kept
        if m == n:
            break
        n = m
    return left


def _wide_parts(edges: DataFrame) -> DataFrame:
    """scope, node, scc, size for scopes too large for a task: colour forward with the least id, then confirm backward."""
    spark = edges.sparkSession
    left = _core(edges)
    found = []
    while not left.isEmpty():
        colour = materialize(left.select("scope", F.col("src").alias("node")).union(left.select("scope", "dst")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            sent = left.join(colour.withColumnRenamed("node", "src"), ["scope", "src"]).select("scope", F.col("dst").alias("node"), "colour")
            new = materialize(colour.union(sent).groupBy("scope", "node").agg(F.min("colour").alias("colour")), "colour")
            changed = not new.exceptAll(colour).isEmpty()
            colour = new
            if not changed:
                break
        same = left.join(colour.withColumnRenamed("node", "src"), ["scope", "src"]).join(colour.select("scope", F.col("node").alias("dst"), F.col("colour").alias("c2")), ["scope", "dst"]).filter("colour = c2")
        roots = colour.filter("node = colour").select("scope", "colour", "node")
        back = reach(same.select("scope", "colour", F.col("dst").alias("src"), F.col("src").alias("dst")), roots, ["scope", "colour"])
        part = materialize(back.select("scope", "node", F.col("colour").alias("scc")), "part")
        found.append(part)
        gone = part.select("scope", "node")
        left = left.join(gone.withColumnRenamed("node", "src"), ["scope", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["scope", "dst"], "left_anti")
        left = _core(left.select("scope", "src", "dst"))
    if not found:
        return spark.createDataFrame([], "scope string, node long, scc long, size int")
    whole = reduce(DataFrame.unionByName, found)
    sizes = whole.groupBy("scope", "scc").agg(F.count(F.lit(1)).cast("int").alias("size")).filter("size > 1")
    return whole.join(sizes, ["scope", "scc"]).select("scope", "node", "scc", "size")


def _split(edges: DataFrame, scope: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    flat = materialize(edges.select(F.col(scope).cast("string").alias("scope"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna().filter("src <> dst").distinct(), "graph")
    large = flat.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("scope")
    if large.isEmpty():
        return flat, None
    large = materialize(large, "large")
    return flat.join(large, "scope", "left_anti"), flat.join(large, "scope", "left_semi")


def strong_components(edges: DataFrame, scope: str, limit: int = SCOPE_EDGES) -> DataFrame:
    """scope, node, scc (its least node), size: nodes of components of two or more. edges: scope, src, dst (ids)."""
    small, wide = _split(edges, scope, limit)
    schema = pa.schema([("scope", pa.string()), ("node", pa.int64()), ("scc", pa.int64()), ("size", pa.int32())])
    dealt = small.repartition("scope").sortWithinPartitions("scope")
    out = dealt.mapInArrow(_scoped(_find_parts, schema), "scope string, node long, scc long, size int")
    return out if wide is None else out.unionByName(_wide_parts(wide))


def shortest_cycles(edges: DataFrame, scope: str, limit: int = SCOPE_EDGES) -> DataFrame:
    """scope, scc, size, cycle: one shortest cycle of each strong component; the least of equally short ones.

    A scope of more edges than ``limit`` is first narrowed to its components by joins; each
    component is then searched in a task.
    """
    small, wide = _split(edges, scope, limit)
    schema = pa.schema([("scope", pa.string()), ("scc", pa.int64()), ("size", pa.int32()), ("cycle", pa.list_(pa.int64()))])
    ddl = "scope string, scc long, size int, cycle array<long>"
    dealt = small.repartition("scope").sortWithinPartitions("scope")
    out = dealt.mapInArrow(_scoped(_find_cycles, schema), ddl)
    if wide is None:
        return out
    parts = materialize(_wide_parts(wide), "parts")
    a = parts.select("scope", F.col("node").alias("src"), "scc")
    b = parts.select("scope", F.col("node").alias("dst"), F.col("scc").alias("scc2"))
    inner = wide.join(a, ["scope", "src"]).join(b, ["scope", "dst"]).filter("scc = scc2")
    named = inner.select(F.concat_ws("\x00", "scope", F.col("scc").cast("string")).alias("key"), "src", "dst")
    dealt = named.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_scoped(_find_cycles, schema), ddl)
    return out.unionByName(found.withColumn("scope", F.substring_index("scope", "\x00", 1)))
