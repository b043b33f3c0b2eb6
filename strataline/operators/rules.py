"""Dependency and graph rules over file edges.

Findings have: rule_id, severity, engine, repo, file, line (null for graph rules), message, detail.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.paths import under
from strataline.operators.graph import nearest, shortest_cycles
from strataline.session import materialize

FINDING = "rule_id string, severity string, engine string, repo string, file string, line int, message string, detail string"


def with_groups(pattern: str, source: str, column: Column) -> Column:
    """``pattern`` with $n replaced by the groups of ``source`` matched on the column; $0 is the whole match.

    Groups that the source does not have are empty. What was captured stays live in the pattern.
    """
    groups = re.compile(source).groups
    parts = re.split(r"\$(\d+)", pattern)
    out = [F.lit(parts[0])]
    for n, text in zip(parts[1::2], parts[2::2]):
        out += [F.regexp_extract(column, source, int(n)) if int(n) <= groups else F.lit(""), F.lit(text)]
    return F.concat(*out) if len(out) > 1 else out[0]


def _reaches(rule: dict, src: Column, dst: Column) -> Column:
    hit = F.regexp_like(dst, with_groups(rule["to"], rule["from"], src))
    return hit & ~F.regexp_like(dst, with_groups(rule["toNot"], rule["from"], src)) if rule.get("toNot") else hit


def _finding(df: DataFrame, law: dict, engine: str, line: Column, detail: Column) -> DataFrame:
    lit = lambda k: F.lit(law.get(k))
    return df.select(
        lit("id").alias("rule_id"), lit("severity").alias("severity"), F.lit(engine).alias("engine"), "repo", F.col("src").alias("file"),
        line.cast("int").alias("line"), lit("prose").alias("message"), detail.alias("detail"),
    )


def dependency_findings(edges: DataFrame, files: DataFrame, law: dict, paths: list[str] | None = None) -> DataFrame:
    """A forbidden rule finds edges from ``from`` to ``to`` but not ``toNot``; a required one finds files without such an edge.

    edges: repo, src_id, src, dst, line, kept to the rule's kinds beforehand or with a column ``kind``.
    """
    rule = law["verification"]["rule"]
    edges = edges.filter(F.col("kind").isin(rule["edgeKinds"])) if rule.get("edgeKinds") and "kind" in edges.columns else edges
    mine = edges.filter(under(F.col("src"), paths) & F.col("src").rlike(rule["from"]))
    hits = mine.filter(_reaches(rule, F.col("src"), F.col("dst")))
    if rule.get("type", "forbidden") == "forbidden":
        one = hits.groupBy("repo", "src", "dst").agg(F.min("line").alias("line"))
        return _finding(one, law, "deps", F.col("line"), F.concat(F.lit("→ "), F.col("dst")))
    wanted = files.select(F.col("id").alias("src_id"), F.col("path").alias("src"), "repo").filter(under(F.col("src"), paths) & F.col("src").rlike(rule["from"]))
    lacking = wanted.join(hits.select("src_id").distinct(), "src_id", "left_anti")
    return _finding(lacking, law, "deps", F.lit(None), F.lit(f"required dependency to {rule['to']} is missing"))


def unresolved_in_scopes(unresolved: DataFrame, laws: list[dict], paths: list[str] | None = None) -> list[int]:
    """For each rule the edges without a target whose source and kind it covers, in one scan. unresolved: src, kind, n."""
    if not laws:
        return []
    sums = []
    for law in laws:
        rule = law["verification"]["rule"]
        covered = F.col("src").rlike(rule["from"])
        covered = covered & F.col("kind").isin(rule["edgeKinds"]) if rule.get("edgeKinds") else covered
        sums.append(F.sum(F.when(covered, F.col("n"))))
    return [n or 0 for n in unresolved.filter(under(F.col("src"), paths)).agg(*(c.alias(f"n{i}") for i, c in enumerate(sums))).first()]


def cycle_findings(edges: DataFrame, files: DataFrame, law: dict, paths: list[str] | None = None) -> DataFrame:
    """One shortest cycle for each strongly connected group of files, named by paths."""
    inside = edges.filter(under(F.col("src"), paths) & under(F.col("dst"), paths))
    found = shortest_cycles(inside.select(F.col("repo").alias("scope"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "scope")
    found = materialize(found, "cycles")
    steps = found.select("scope", "scc", "size", F.posexplode("cycle").alias("pos", "id")).join(files.select("id", "path"), "id")
    chain = steps.groupBy("scope", "scc", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("p"))
    shown = chain.select(F.col("scope").alias("repo"), F.element_at("p", 1).alias("src"), F.concat(F.lit("cycle: "), F.array_join(F.concat("p", F.slice("p", 1, 1)), " → "), F.lit(" (SCC size "), F.col("size").cast("string"), F.lit(")")).alias("detail"))
    return _finding(shown, law, "graph", F.lit(None), F.col("detail"))


def reach_findings(edges: DataFrame, files: DataFrame, law: dict, paths: list[str] | None = None) -> DataFrame:
    """Files of ``from`` that reach a file of ``to`` over edges; the nearest is named, of equally near ones the least id."""
    rule = law["verification"]["rule"]
    inside = edges.filter(under(F.col("src"), paths) & under(F.col("dst"), paths) & (F.col("src_id") != F.col("dst_id")))
    inside = materialize(inside.select("repo", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "inside")
    # only files with an edge are in the graph
    start = files.filter(F.col("path").rlike(rule["from"])).join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    goal = files.filter(F.col("path").rlike(rule["to"])).select("repo", F.col("id").alias("node"))
    found = nearest(inside, start.select("repo", F.col("id").alias("node")), goal, ["repo"])
    named = found.join(files.select(F.col("id").alias("origin"), F.col("path").alias("src")), "origin").join(files.select(F.col("id").alias("hit"), F.col("path").alias("dst")), "hit")
    return _finding(named, law, "graph", F.lit(None), F.concat(F.lit("transitively reaches "), F.col("dst")))


def graph_findings(edges: DataFrame, files: DataFrame, law: dict, paths: list[str] | None = None) -> DataFrame:
    """Cycles unless only reachability with both ends is asked for; both if both are."""
    rule = law["verification"]["rule"]
    reachable = bool(rule.get("reachable") is True and rule.get("from") and rule.get("to"))
    circular = rule.get("circular") is True or not (rule.get("circular") or reachable)
    parts = ([cycle_findings(edges, files, law, paths)] if circular else []) + ([reach_findings(edges, files, law, paths)] if reachable else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fingerprint() -> Column:
    return F.concat_ws(":", "rule_id", "file", F.coalesce(F.col("line"), F.lit(0)).cast("string"))


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "error", 3).when(F.col(column) == "warn", 2).when(F.col(column) == "info", 1).otherwise(0)
