"""Parent-child links to full hierarchies, as nested sets.

1. Chains are followed to give every row the label of its tree: first as far as they go inside
   the rows that a task happens to hold, then by pointer doubling. Rows that are still on their
   way double the links of what they point to, so a chain of n links takes at most log2(n)
   rounds over ever fewer rows; the last ``tree_rows`` of them are finished in one task. Rows
   that never get to an end are cyclic.
2. A tree goes whole to one task and many trees share a task. There, level by level:
   subtree sizes are summed upward from the leaves, then sibling ranges of preorder numbers
   are allotted downward from the root by prefix sums. What the upward pass never frees
   lies on a cycle; what the downward pass never reaches hangs under one.
3. A tree of more than ``tree_rows`` rows is not gathered: the same two passes run over it as
   DataFrames. Round k takes 2^k levels at once (each row hands its sum to its 2^k-th
   ancestor, and takes the sum of the way from there), so a tree of depth d takes log2(d)
   rounds, not d. Siblings' prefix sums are taken in two steps over a range partitioning.

pre is the place of a node in its tree's preorder and size the count of its descendants:
b descends from a if both have one root and pre(a) < pre(b) <= pre(a) + size(a).
``descendants`` and ``ancestors`` read these ranges. All operators here run jobs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.operators.references import salted_join
from strataline.session import materialize, table, width

#: Trees up to so many rows are worked on inside one task.
TREE_ROWS = 200_000
#: Preorder numbers have at most so many binary digits.
LEVELS = 48

SCHEMA = "id long, root long, depth int, pre long, size long, state string, path array<long>"
STATES = ("ok", "other_file", "broken", "under_cycle", "on_cycle")


def _by_key(refs: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """refs with what the tables (key, ...) say of each key, or nulls. A key is looked up once, then dealt out."""
    keys = refs.groupBy(key).agg(F.count(F.lit(1)).alias("n_refs"))
    for t in tables:
        keys = keys.join(t, key, "left")
    return salted_join(refs, keys, [key], "id")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's way through the rows at hand, whichever they are: top (an end, or the first row elsewhere), dist, low, ended.

    Rows that run into a loop here keep their own link.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, parent, there = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "at", "there"))
        order = np.argsort(ids, kind="stable")
        ids, parent, there = ids[order], parent[order], there[order]
        n = len(ids)
        at = np.minimum(np.searchsorted(ids, parent), n - 1)
        local = there & (ids[at] == parent)
        up, dist, low = np.where(local, at, np.arange(n)), local.astype(np.int64), ids.copy()
        for _ in range(n.bit_length() + 1):
            beyond = up[up]
            if (beyond == up).all():
                break
            low, dist, up = np.minimum(low, low[up]), dist + dist[up], beyond
        looped = local[up]
        ended = ~there[up] & ~looped
        top = np.where(looped, parent, np.where(ended, ids[up], parent[up]))
        dist = np.where(looped, 1, dist + ~ended).astype(np.int32)
        low = np.minimum(np.where(looped, ids, np.minimum(low, low[up])), top)
        out = pa.table([ids, top, dist, low, ended], names=["id", "top", "dist", "low", "ended"])
        yield from out.to_batches(max_chunksize=50_000)

    held, rows = [], 0
    for b in batches:
        parent = b.column("parent").fill_null(0)
        held.append(pa.RecordBatch.from_arrays([b.column("id"), parent, b.column("there")], names=["id", "at", "there"]))
        rows += b.num_rows
        if rows >= TREE_ROWS:
            yield from work(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from work(pa.Table.from_batches(held))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows that are still on their way, in one task: id, tree, dist, ring. far and more are what is known of a top that has ended."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    bare = t["far"].is_null().to_numpy(zero_copy_only=False)
    ids, top, dist, low, far, more = (t[c].fill_null(0).to_numpy().astype(np.int64) for c in ("id", "top", "dist", "low", "far", "more"))
    order = np.argsort(ids, kind="stable")
    ids, top, dist, low, far, more, bare = (x[order] for x in (ids, top, dist, low, far, more, bare))
    n = len(ids)
    # every top has ended or is among the rows
    up, way = np.where(bare, np.minimum(np.searchsorted(ids, top), n - 1), np.arange(n)), np.where(bare, dist, 0)
    for _ in range(n.bit_length() + 1):
        low, way, up = np.minimum(low, low[up]), way + way[up], up[up]
    looped = bare[up]
    ring = np.zeros(n, bool)
    ring[up[looped]] = True  # after as many steps as there are rows all are on their loops
    tree = np.where(looped, low[up], far[up])
    links = pa.array((way + dist[up] + more[up]).astype(np.int32), mask=looped)
    yield from pa.table([pa.array(ids), pa.array(tree), links, pa.array(ring)], names=["id", "tree", "dist", "ring"]).to_batches(max_chunksize=50_000)


def _label(rows: DataFrame, limit: int) -> DataFrame:
    """id, parent, grp, there, crosses + tree (label), dist (links to the top; null on or under a cycle), ring (on a cycle).

    rows: id, parent, grp with unique ids. As few as ``limit`` rows on their way are finished in one task.
    """
    up = rows.select(F.col("id").alias("parent"), F.col("grp").alias("up_grp"), F.lit(True).alias("there"))
    below = _by_key(rows.filter("parent is not null"), "parent", up)
    there = F.coalesce(F.col("there"), F.lit(False))
    below = below.select("id", "parent", "grp", there.alias("there"), (there & ~F.col("grp").eqNullSafe(F.col("up_grp"))).alias("crosses"))
    top = rows.filter("parent is null").select("id", "parent", "grp", F.lit(False).alias("there"), F.lit(False).alias("crosses"))
    linked = materialize(below.unionByName(top), "linked")
    # links inside a group are mostly links inside a task's rows too
    near = linked.select("id", "parent", "there", "grp").repartitionByRange("grp", "id").drop("grp").mapInArrow(_contract, "id long, top long, dist int, low long, ended boolean")
    near = materialize(near, "near")
    ended = near.filter("ended").select("id", "top", "dist")
    going = near.filter("not ended").drop("ended")
    n, steps, stuck, rest = going.count(), 1, False, None
    while n and not (stuck and steps >= n):
        # a row's top has ended in an earlier round, or it is going too
        at_end = ended.select(F.col("id").alias("top"), F.col("top").alias("far"), F.col("dist").alias("more"))
        if n <= limit:
            rest = _by_key(going, "top", at_end).select("id", "top", "dist", "low", "far", "more").coalesce(1)
            rest = materialize(rest.mapInArrow(_finish, "id long, tree long, dist int, ring boolean"), "rest")
            break
        on_way = going.select(F.col("id").alias("top"), F.col("top").alias("far2"), F.col("dist").alias("more2"), F.col("low").alias("low2"))
        via = _by_key(going, "top", at_end, on_way)
        moved = via.select(
            "id", F.coalesce("far", "far2").alias("top"), (F.col("dist") + F.coalesce("more", "more2")).alias("dist"),
            F.least("low", "low2").alias("low"), F.col("far").isNotNull().alias("ended"),
        )
        moved = materialize(moved, "moved")
        ended = ended.unionByName(moved.filter("ended").select("id", "top", "dist"))
        going = moved.filter("not ended").drop("ended")
        left = going.count()
        # the row nearest to its end gets there in every round: once none are lost, all that is left is cyclic
        stuck, n, steps = left == n, left, min(steps * 2, 1 << 30)
    labels = ended.select("id", F.col("top").alias("tree"), "dist", F.lit(False).alias("ring"))
    if rest is not None:
        labels = labels.unionByName(rest)
    elif n:
        # after as many steps as there are rows every top lies on its cycle and has seen all of it, and every row of a cycle is a top
        lows = going.select(F.col("id").alias("top"), F.col("low").alias("tree"))
        rings = going.select(F.col("top").alias("id")).distinct().withColumn("ring", F.lit(True))
        cyclic = _by_key(going.select("id", "top"), "top", lows).join(rings, "id", "left")
        labels = labels.unionByName(cyclic.select("id", "tree", F.lit(None).cast("int").alias("dist"), F.coalesce("ring", F.lit(False)).alias("ring")))
    return linked.join(labels, "id")


def _passes(ids: np.ndarray, parent: np.ndarray, there: np.ndarray, crosses: np.ndarray, bare: np.ndarray) -> dict[str, np.ndarray]:
    """Both passes over a forest held in arrays; all its links end inside it."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ids, parent, there, crosses, bare = (x[order] for x in (ids, parent, there, crosses, bare))
    up = np.where(there, np.searchsorted(ids, parent), -1)
    up = np.where(there & (up < n), up, -1)
    # upward: free the leaves, then whoever has no child left
    waiting = np.bincount(up[up >= 0], minlength=n)
    size = np.zeros(n, np.int64)
    freed = np.zeros(n, bool)
    level = np.flatnonzero(waiting == 0)
    while len(level):
        freed[level] = True
        above = up[level]
        inner = above >= 0
        np.add.at(size, above[inner], size[level[inner]] + 1)
        np.subtract.at(waiting, above[inner], 1)
        above = np.unique(above[inner])
        level = above[(waiting[above] == 0) & ~freed[above]]
    # downward: siblings side by side in order of id, each after the sizes of those before it
    by_up = np.lexsort((ids, up))
    first = np.searchsorted(up[by_up], np.arange(n))
    last = np.searchsorted(up[by_up], np.arange(n), side="right")
    total = np.concatenate([[0], np.cumsum(size[by_up] + 1)])
    pre, depth, root = np.full(n, -1, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int64)
    across = crosses.copy()
    level = np.flatnonzero(up < 0)
    pre[level], depth[level], root[level] = 0, 0, level
    while len(level):
        count = last[level] - first[level]
        at = np.repeat(first[level] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        over = np.repeat(level, count)
        below = by_up[at]
        pre[below] = pre[over] + 1 + total[at] - total[first[over]]
        depth[below], root[below] = depth[over] + 1, root[over]
        across[below] |= across[over]
        level = below
    reached = pre >= 0
    top = np.where(reached, root, 0)
    state = np.where(~reached, np.where(freed, 3, 4), np.where(~bare[top], 2, np.where(across, 1, 0)))
    return {"ids": ids, "up": up, "root": root, "depth": depth, "pre": pre, "size": size, "state": state, "reached": reached}


def _paths(found: dict[str, np.ndarray]) -> pa.Array:
    """The ids from root to node, built downward; null where a cycle leaves no root."""
    ids, up, depth, reached = found["ids"], found["up"], found["depth"], found["reached"]
    length = np.where(reached, depth + 1, 0)
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.empty(start[-1], np.int64)
    node = np.arange(len(ids))[reached]
    place = start[:-1][reached] + depth[reached]
    while len(node):
        flat[place] = ids[node]
        node, place = up[node], place - 1
        going = node >= 0
        node, place = node[going], place[going]
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat), mask=pa.array(~reached))


def _batches(with_path: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tree; a chunk is cut where a tree ends."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            get = lambda c: t[c].to_numpy(zero_copy_only=False)
            parent = t["parent"].fill_null(-1).to_numpy()
            f = _passes(get("id"), parent, get("there"), get("crosses"), t["parent"].is_null().to_numpy(zero_copy_only=False))
            hidden = ~f["reached"]
            where = np.where(hidden, 0, f["root"])
            cols = [
                pa.array(f["ids"]), pa.array(f["ids"][where], mask=hidden), pa.array(f["depth"], mask=hidden), pa.array(f["pre"], mask=hidden),
                pa.array(f["size"], mask=hidden), pa.array(np.array(STATES, dtype=object)[f["state"]], pa.string()),
            ]
            names = ["id", "root", "depth", "pre", "size", "state"]
            if with_path:
                cols.append(_paths(f))
                names.append("path")
            out = pa.table(cols, names=names)
            yield from out.to_batches(max_chunksize=20_000)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= TREE_ROWS:
                t = pa.Table.from_batches(held)
                tree = t["tree"].to_numpy()
                cut = int(np.searchsorted(tree, tree[-1]))
                if cut:
                    yield from chunk(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows = t.num_rows - cut
        if rows:
            yield from chunk(pa.Table.from_batches(held))

    return work


def _sizes(rows: DataFrame) -> DataFrame:
    """id, size (descendants) of acyclic rows (id, parent, there): the upward pass, twice as many levels in each round.

    In round k a row holds the sum of itself and the levels less than 2^k below, and hands it to
    its 2^k-th ancestor. Only rows that have one go on.
    """
    going = materialize(rows.filter("there").select("id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("held")), "up")
    parts = [rows.filter("not there").select("id", F.lit(1).cast("long").alias("held"))]
    while not going.isEmpty():
        sent = going.groupBy(F.col("jump").alias("id")).agg(F.sum("held").alias("more"))
        ahead = _by_key(going, "jump", going.select(F.col("id").alias("jump"), F.col("jump").alias("next")))
        got = ahead.select("id", "held", "next").join(sent, "id", "full")
        got = materialize(got.select("id", F.col("next").alias("jump"), (F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("held")), "up")
        parts.append(got.filter("jump is null").select("id", "held"))
        going = got.filter("jump is not null")
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.sum("held") - 1).alias("size"))


def _places(kids: DataFrame) -> DataFrame:
    """id, parent, crosses, size + gap: how far a node's pre is from its parent's; siblings in order of id.

    Ranges of (parent, id) are summed by task first, so the children of one node may fill many tasks.
    """
    dealt = materialize(kids.repartitionByRange(width(kids.sparkSession), "parent", "id").withColumn("pid", F.spark_partition_id()), "kids")
    parts = dealt.groupBy("parent", "pid").agg(F.sum(F.col("size") + 1).alias("whole"))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each task that a parent's children are in
    ahead = parts.withColumn("ahead", before("whole", "parent", "pid")).select("parent", "pid", "ahead")
    inside = dealt.withColumn("inside", before(F.col("size") + 1, "parent", "pid", "id"))
    return inside.join(ahead, ["parent", "pid"]).withColumn("gap", F.col("ahead") + F.col("inside") + 1).drop("pid", "ahead", "inside")


def _wide(rows: DataFrame, with_path: bool) -> DataFrame:
    """Both passes over trees too large for a task, see the module. rows: as _label gives them."""
    acyclic = rows.filter("dist is not null")
    sized = materialize(acyclic.select("id", "parent", "there", "crosses").join(_sizes(acyclic), "id"), "sized")
    path = lambda c: F.array(c) if with_path else F.lit(None).cast("array<long>")
    top = sized.filter("not there").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("pre"), F.lit(False).alias("across"), F.col("parent").isNull().alias("bare"), path("id").alias("path"))
    places = _places(sized.filter("there").drop("there"))
    # downward: what a row knows is the way from below its jump to itself
    going = materialize(places.select("id", F.col("parent").alias("jump"), F.col("gap").alias("way"), F.col("crosses").alias("over"), path("id").alias("steps")), "down")
    parts = [top]
    while not going.isEmpty():
        done = reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": "jump", "path": "front"})
        on_way = going.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("way").alias("way2"), F.col("over").alias("over2"), F.col("steps").alias("steps2"))
        via = _by_key(going, "jump", done, on_way)
        full = F.concat(F.coalesce("front", "steps2"), "steps") if with_path else F.lit(None).cast("array<long>")
        moved = via.select(
            "id", "next", "root", "bare", (F.coalesce("pre", "way2") + F.col("way")).alias("way"), (F.coalesce("across", "over2") | F.col("over")).alias("over"), full.alias("steps"),
        )
        moved = materialize(moved, "down")
        parts.append(moved.filter("root is not null").select("id", "root", F.col("way").alias("pre"), F.col("over").alias("across"), "bare", F.col("steps").alias("path")))
        going = moved.filter("root is null").select("id", F.col("next").alias("jump"), "way", "over", "steps")
    state = F.when(~F.col("bare"), F.lit("broken")).when(F.col("across"), F.lit("other_file")).otherwise(F.lit("ok"))
    reached = reduce(DataFrame.unionByName, parts).join(sized.select("id", "size"), "id").join(acyclic.select("id", "dist"), "id")
    out = reached.select("id", "root", F.col("dist").alias("depth"), "pre", "size", state.alias("state"), "path")
    # never reached by the downward pass
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("root", "long"), ("depth", "int"), ("pre", "long"), ("size", "long"))]
    cyclic = rows.filter("dist is null").select("id", *nulls, F.when(F.col("ring"), "on_cycle").otherwise("under_cycle").alias("state"), F.lit(None).cast("array<long>").alias("path"))
    return out.unionByName(cyclic)


def hierarchy(
    df: DataFrame, node: str = "id", parent: str = "parent_id", group: str | None = None, with_path: bool = True, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """One row for each node: id, root, depth, pre, size, state and path (root to node).

    state: ``on_cycle``, ``under_cycle`` (both with nulls elsewhere), ``broken`` (the chain
    ends at a parent that no row has; the row under that gap stands as root), ``other_file``
    (some link of the chain joins two values of ``group``), ``ok``.

    Rows with a null node id are no nodes. Repeated rows of an id count once; if they differ,
    the smallest parent and group hold. A null group is a value of its own. An empty table
    gives an empty result. Other columns are not read, so their names cannot clash. Siblings
    stand in order of id.
    """
    grp = F.col(group) if group else F.lit(0)
    rows = df.select(F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("parent"), grp.alias("grp")).filter("id is not null")
    rows = rows.groupBy("id").agg(F.min("parent").alias("parent"), F.min("grp").alias("grp"))
    rows = materialize(_label(rows, tree_rows), "labelled")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_rows)
    large = materialize(sizes.select("tree"), "large")
    n_large = large.count()
    schema = SCHEMA if with_path else SCHEMA.rpartition(",")[0]
    cols = ["id", "parent", "there", "crosses", "tree"]
    # more large trees than rows / tree_rows there cannot be; without any, no join is made
    small = rows.join(large, "tree", "left_anti") if n_large else rows
    out = small.select(*cols).repartition("tree").sortWithinPartitions("tree").mapInArrow(_batches(with_path), schema)
    if n_large:
        wide = _wide(rows.join(large, "tree", "left_semi"), with_path)
        out = out.unionByName(wide if with_path else wide.drop("path"))
    return out


def _dyadic(low: Column, high: Column) -> Column:
    """Array of (level, at): the intervals at * 2^level .. (at + 1) * 2^level - 1 that low..high is made of, at most two of a level."""
    none = F.array().cast("array<struct<level:int,at:bigint>>")
    start = F.struct(low.alias("l"), (high + 1).alias("r"), none.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        l, r = acc["l"], acc["r"]
        take = lambda side, at: F.when((l < r) & (side % 2 == 1), F.array(F.struct(level.alias("level"), at.alias("at")))).otherwise(none)
        l2, r2 = F.shiftright(l + l % 2, 1), F.shiftright(r - r % 2, 1)
        return F.struct(l2.alias("l"), r2.alias("r"), F.concat(acc["out"], take(l, l), take(r, r - 1)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda acc: acc["out"])


def lineage(tree: DataFrame, above: DataFrame | None = None, below: DataFrame | None = None) -> DataFrame:
    """above, below, steps: pairs of an ancestor and a descendant, read from the nested sets of ``hierarchy``.

    ``above`` and ``below`` (id) limit either side. The descendants of a node are a range of
    preorder numbers, which is cut to dyadic intervals; a node lies in one interval of each
    level, so pairs are met by equality and none is met in vain. Cyclic nodes have no ranges
    and are in no pair; an empty table gives an empty result.
    """
    nodes = tree.filter("root is not null").select("id", "root", "depth", "pre", "size")
    upper = nodes.filter("size > 0")
    upper = upper if above is None else upper.join(above.select("id").distinct(), "id", "left_semi")
    lower = nodes if below is None else nodes.join(below.select("id").distinct(), "id", "left_semi")
    cut = upper.select("root", F.col("id").alias("above"), F.col("depth").alias("from"), F.explode(_dyadic(F.col("pre") + 1, F.col("pre") + F.col("size"))).alias("i"))
    # numbers are dense, so an interval of level l holds 2^l nodes
    keys = cut.select("root", "i.level", "i.at", "above", "from", F.expr("shiftleft(1L, i.level)").alias("n_refs"))
    tops = nodes.filter("depth = 0").select("root", (F.col("size") + 1).alias("n_refs"), F.ceil(F.log2(F.col("size") + 1)).cast("int").alias("top"))
    placed = salted_join(lower, tops, ["root"], "id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    placed = placed.select("root", "level", F.expr("shiftright(pre, level)").alias("at"), F.col("id").alias("below"), "depth")
    met = salted_join(placed, keys, ["root", "level", "at"], "below")
    return met.select("above", "below", (F.col("depth") - F.col("from")).alias("steps"))


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id, descendant_id, steps for the nodes of ``of`` (id), or all. See lineage."""
    return lineage(tree, above=of).select(F.col("above").alias("node_id"), F.col("below").alias("descendant_id"), "steps")


def ancestors(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id, ancestor_id, steps for the nodes of ``of`` (id), or all. See lineage."""
    return lineage(tree, below=of).select(F.col("below").alias("node_id"), F.col("above").alias("ancestor_id"), "steps")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes", "id", "parent_id", "file_id")
    return hierarchy(nodes, group="file_id", with_path=False).filter("state <> 'ok'").select(F.col("id").alias("node_id"), "state")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path, depth, root, count of descendants and nested-set range."""
    nodes = table(spark, sf_dir, "nodes", "id", "parent_id", "file_id")
    full = hierarchy(nodes, group="file_id")
    return full.select(
        F.col("id").alias("node_id"), "root", "depth", "pre", (F.col("pre") + F.col("size")).alias("last_pre"), "size",
        F.concat_ws("/", "path").alias("path"), "state",
    )


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(hierarchy(table(spark, sf_dir, "nodes", "id", "parent_id", "file_id"), group="file_id", with_path=False), "tree")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with each of its descendants and the steps between them."""
    return descendants(_tree(spark, sf_dir))


def p5_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node without children, with each of its ancestors."""
    tree = _tree(spark, sf_dir)
    return ancestors(tree, tree.filter("size = 0"))
