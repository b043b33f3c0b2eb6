"""Structural queries over the code graph: resolution, search, explore, impact, trace, neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.graph import path_back, reach


def with_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with the path and repo of their file; nodes without one drop out."""
    return nodes.join(files.select(F.col("id").alias("file_id"), "path", "repo"), "file_id")


def resolve_calls(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """edges with ``target``: a call's dst_node_id, or else the least node of that name in the repository of its source.

    Imports have no target. Every call is resolved anew, so none keeps a target that is gone.
    """
    named = with_file(nodes.select("id", "name", "file_id"), files).filter("name is not null")
    first = named.groupBy("repo", F.col("name").alias("dst_name")).agg(F.min("id").alias("by_name"))
    at = files.select(F.col("id").alias("src_file_id"), "repo")
    there = nodes.select(F.col("id").alias("dst_node_id"), F.col("id").alias("alive"))
    whole = edges.join(at, "src_file_id", "left").join(first, ["repo", "dst_name"], "left").join(there, "dst_node_id", "left")
    return whole.withColumn("target", F.when(F.col("kind") == "call", F.coalesce("alive", "by_name"))).drop("alive", "by_name")


def search(nodes: DataFrame, files: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Names that hold the text (LIKE wildcards stay live, case ignored): exact first, then short, then by name and id."""
    hits = nodes.filter(F.col("name").ilike(f"%{text}%"))
    hits = with_file(hits, files).withColumn("exact", (F.col("name") == text).cast("int"))
    top = hits.orderBy(F.desc("exact"), F.length("name"), "name", "id").limit(limit)
    return top.select("id", "name", "kind", "repo", F.col("path").alias("file"), F.col("start_line").alias("line"), "signature")


def best_match(nodes: DataFrame, files: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Exact matches, functions before classes before the rest, then by id."""
    rank = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "class", 1).otherwise(2)
    return with_file(nodes.filter(F.col("name") == name), files).withColumn("rank", rank).orderBy("rank", "id").limit(limit)


def callees(edges: DataFrame, nodes: DataFrame, files: DataFrame, owner: DataFrame) -> DataFrame:
    """Calls out of the nodes of ``owner`` (id); unresolved ones are kept with nulls."""
    calls = edges.filter("kind = 'call'").join(owner.select(F.col("id").alias("src_node_id")), "src_node_id", "left_semi")
    goal = nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), "file_id", F.col("start_line").alias("target_line"))
    whole = calls.join(goal, "target", "left").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return whole.select(F.col("src_node_id").alias("owner_id"), F.col("dst_name").alias("name"), "line", "target", "target_kind", F.col("path").alias("file"))


def callers(edges: DataFrame, nodes: DataFrame, files: DataFrame, owner: DataFrame) -> DataFrame:
    """Distinct owners of calls that point at a node of ``owner`` (id, name, repo) or name it inside its repository."""
    calls = edges.filter("kind = 'call' and src_node_id is not null")
    by_id = calls.join(owner.select(F.col("id").alias("target"), F.col("id").alias("owner_id")), "target")
    by_name = calls.join(owner.select("repo", F.col("name").alias("dst_name"), F.col("id").alias("owner_id")), ["repo", "dst_name"])
    both = by_id.select("owner_id", "src_node_id").union(by_name.select("owner_id", "src_node_id")).distinct()
    who = with_file(nodes.select("id", "name", "kind", "start_line", "file_id"), files)
    return both.join(who, both["src_node_id"] == who["id"]).select("owner_id", F.col("id").alias("caller_id"), "name", "kind", F.col("path").alias("file"), F.col("start_line").alias("line"))


def name_calls(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """repo, caller (name of the owning node), callee (name called), src_node_id of each call."""
    calls = edges.filter("kind = 'call' and dst_name is not null").select("src_node_id", F.col("dst_name").alias("callee"))
    owner = with_file(nodes.select("id", "name", "file_id"), files).filter("name is not null").select(F.col("id").alias("src_node_id"), F.col("name").alias("caller"), "repo")
    return calls.join(owner, "src_node_id")


def impact(edges: DataFrame, nodes: DataFrame, files: DataFrame, name: str, max_depth: int = 4) -> DataFrame:
    """Nodes that call ``name``, directly or through others, by name, with the first depth; within each repository."""
    calls = name_calls(edges, nodes, files)
    seeds = calls.select("repo").distinct().withColumn("node", F.lit(name))
    back = calls.select("repo", F.col("callee").alias("src"), F.col("caller").alias("dst"))
    names = reach(back, seeds, ["repo"], max_depth - 1).select("repo", F.col("node").alias("callee"), "depth")
    hit = calls.join(names, ["repo", "callee"]).groupBy(F.col("src_node_id").alias("id")).agg((F.min("depth") + 1).alias("depth"))
    who = with_file(nodes.select("id", "name", "kind", "start_line", "file_id"), files)
    return hit.join(who, "id").select("id", "name", "kind", "repo", F.col("path").alias("file"), F.col("start_line").alias("line"), "depth")


def trace(edges: DataFrame, nodes: DataFrame, files: DataFrame, start: str, goal: str, max_depth: int = 8) -> DataFrame:
    """repo, path, hops: the shortest chain of names from start to goal in each repository; null and -1 without one."""
    calls = name_calls(edges, nodes, files)
    repos = calls.select("repo").distinct()
    forward = calls.select("repo", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    reached = reach(forward, repos.withColumn("node", F.lit(start)), ["repo"], max_depth, until=repos.withColumn("node", F.lit(goal)))
    found = path_back(reached, ["repo"], goal)
    return repos.join(found, "repo", "left").select("repo", F.array_join("path", " -> ").alias("path"), F.coalesce("hops", F.lit(-1)).alias("hops"))


def links(edges: DataFrame) -> DataFrame:
    """s, t of resolved calls with an owner; parallel calls and self-calls stay."""
    return edges.filter("kind = 'call' and target is not null and src_node_id is not null").select(F.col("src_node_id").alias("s"), F.col("target").alias("t"))


def degrees(pairs: DataFrame) -> DataFrame:
    """id, deg: calls at either end; parallel ones count, self-calls do not."""
    apart = pairs.filter("s <> t")
    return apart.select(F.explode(F.array("s", "t")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))


def top_by_degree(nodes: DataFrame, files: DataFrame, pairs: DataFrame, limit: int = 300) -> DataFrame:
    deg = with_file(nodes.select("id", "name", "kind", "start_line", "file_id"), files).join(degrees(pairs), "id", "left")
    deg = deg.withColumn("deg", F.coalesce("deg", F.lit(0).cast("long")))
    return deg.orderBy(F.desc("deg"), "id").limit(limit).select("id", "name", "kind", F.col("path").alias("file"), F.col("start_line").alias("line"), "deg")


def neighbourhood(nodes: DataFrame, files: DataFrame, pairs: DataFrame, focus: str, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` undirected calls of the nodes named ``focus``, with their degree and distance."""
    both = pairs.select(F.col("s").alias("src"), F.col("t").alias("dst")).union(pairs.select("t", "s")).filter("src <> dst")
    known = with_file(nodes.select("id", "name", "kind", "start_line", "file_id"), files)
    seeds = known.filter(F.col("name") == focus).select(F.col("id").alias("node"))
    near = reach(both, seeds, [], depth).select(F.col("node").alias("id"), "depth")
    out = near.join(known, "id").join(degrees(pairs), "id", "left")
    return out.select("id", "name", "kind", F.col("path").alias("file"), F.col("start_line").alias("line"), F.coalesce("deg", F.lit(0).cast("long")).alias("deg"), "depth")


def induced_links(pairs: DataFrame, included: DataFrame) -> DataFrame:
    """Calls with both ends in ``included`` (id); duplicates and self-calls stay."""
    return pairs.join(included.select(F.col("id").alias("s")), "s", "left_semi").join(included.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t")


def file_graph(edges: DataFrame, nodes: DataFrame, files: DataFrame, kinds: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """repo, src_id, src, dst_id, dst, line: resolved edges between files of one repository, the first line of each pair.

    ``kinds`` limits the kinds of edges; none or an empty list means all. ``by`` (kind) keeps pairs of each kind apart.
    """
    some = edges.filter(F.col("target").isNotNull())
    some = some.filter(F.col("kind").isin(kinds)) if kinds else some
    goal = nodes.select(F.col("id").alias("target"), F.col("file_id").alias("dst_id"))
    pairs = some.join(goal, "target").groupBy(F.col("src_file_id").alias("src_id"), "dst_id", *by).agg(F.min("line").alias("line"))
    left = files.select(F.col("id").alias("src_id"), F.col("path").alias("src"), "repo")
    right = files.select(F.col("id").alias("dst_id"), F.col("path").alias("dst"), F.col("repo").alias("dst_repo"))
    whole = pairs.join(left, "src_id").join(right, "dst_id").filter("repo = dst_repo")
    return whole.select("repo", "src_id", "src", "dst_id", "dst", *by, "line")


def unresolved_by_file(edges: DataFrame, files: DataFrame, kinds: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """repo, src, n: edges without a target per source file (and kind, if ``by`` has it)."""
    some = edges.filter(F.col("target").isNull())
    some = some.filter(F.col("kind").isin(kinds)) if kinds else some
    counted = some.groupBy("src_file_id", *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(files.select(F.col("id").alias("src_file_id"), F.col("path").alias("src"), "repo"), "src_file_id").select("repo", F.col("src_file_id").alias("src_id"), "src", *by, "n")


def explore(nodes: DataFrame, files: DataFrame, edges: DataFrame, name: str, sources: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """What is known of a name, a row for each node: rank, id, name, kind, repo, file, line, signature, exact, callees, callers, source.

    The exact matches in the order of best_match, or else the first ``limit`` names that hold
    the text (search), for which only the place is given. callees: struct<name, line, file>, by line then name,
    unresolved ones with a null file; callers: struct<name, file, line>, by file, line and name. source: the node's
    part of ``sources`` (file_id, text), by the extractors' offsets in characters; null without it. A null or unknown name finds nothing. Jobs: one look whether there is an exact match.
    """
    found = best_match(nodes, files, name, limit)
    exact = found.select("id", "name", "kind", "repo", F.col("path").alias("file"), F.col("start_line").alias("line"), "signature", "file_id", "start_byte", "end_byte", "rank")
    calls = "array<struct<name:string,line:int,file:string>>", "array<struct<name:string,file:string,line:int>>"
    if exact.isEmpty():
        near = search(nodes, files, name, limit) if name else search(nodes, files, "", 0)
        return near.select(F.lit(None).cast("int").alias("rank"), "id", "name", "kind", "repo", "file", "line", "signature", F.lit(False).alias("exact"), F.lit(None).cast(calls[0]).alias("callees"), F.lit(None).cast(calls[1]).alias("callers"), F.lit(None).cast("string").alias("source"))
    out = callees(edges, nodes, files, exact)
    out = out.groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("line", "name", "file"))).alias("c"))
    out = out.select("id", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line"), x["file"].alias("file"))).alias("callees"))
    into = callers(edges, nodes, files, exact)
    into = into.groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("file", "line", "name"))).alias("c"))
    into = into.select("id", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), x["line"].alias("line"))).alias("callers"))
    whole = exact.join(out, "id", "left").join(into, "id", "left")
    if sources is None:
        whole = whole.withColumn("source", F.lit(None).cast("string"))
    else:
        at = F.col("start_byte").between(0, F.col("end_byte"))
        part = F.when(at, F.expr("substring(text, start_byte + 1, end_byte - start_byte)"))
        whole = whole.join(sources.select("file_id", "text"), "file_id", "left").withColumn("source", part)
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return whole.select("rank", "id", "name", "kind", "repo", "file", "line", "signature", F.lit(True).alias("exact"), none("callees", calls[0]), none("callers", calls[1]), "source")
