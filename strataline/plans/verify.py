"""A run of batch rules: findings, and for each rule passed, failed, unknown or skipped. Reports of it."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.paths import relative_uri
from strataline.operators import code_graph as G
from strataline.operators.rules import FINDING, dependency_findings, fingerprint, graph_findings, severity_rank, unresolved_in_scopes
from strataline.session import materialize
from strataline.sources.rules import BATCH_KINDS

#: Results that a SARIF run may hold; what is beyond is counted in a notice.
SARIF_CAP = 5_000
RANKS = {"error": 3, "warn": 2, "info": 1}
STATUS = "rule_id string, status string, detail string"
#: Runs of rules that are under way together.
AT_ONCE = 4


@dataclass
class Report:
    findings: DataFrame
    statuses: DataFrame  # rule_id, status, detail

    def summary(self) -> DataFrame:
        """evaluated, passed, failed, unknown, skipped; a skipped or unknown rule never counts as passed."""
        n = lambda s: F.count_if(F.col("status") == s).alias(s)
        return self.statuses.agg(F.count_if(F.col("status") != "skipped").alias("evaluated"), n("passed"), n("failed"), n("unknown"), n("skipped"))


def select_rules(rules: list[dict], ids: list[str] | None = None, engines: list[str] | None = None) -> list[dict]:
    kind = lambda r: (r.get("verification") or {}).get("kind")
    return [r for r in rules if kind(r) in BATCH_KINDS and (not ids or r["id"] in ids) and (not engines or kind(r) in engines)]


def verify(spark: SparkSession, rules: list[dict], files: DataFrame | None, nodes: DataFrame | None, edges: DataFrame | None, paths: list[str] | None = None, ids: list[str] | None = None, engines: list[str] | None = None) -> Report:
    """Evaluate rules over the index; without one (None) every rule is skipped, an engine's error skips its rule.

    A rule with findings has failed; without any it is unknown if references in its scope have
    no target, else it has passed.
    """
    chosen = select_rules(rules, ids, engines)
    if files is None or nodes is None or edges is None:
        return Report(spark.createDataFrame([], FINDING), spark.createDataFrame([(r["id"], "skipped", "no-index") for r in chosen], STATUS))
    if not chosen:
        return Report(spark.createDataFrame([], FINDING), spark.createDataFrame([], STATUS))
    resolved = materialize(G.resolve_calls(edges, nodes, files), "resolved")
    files = materialize(files.select("id", "path", "repo"), "files")
    pairs = materialize(G.file_graph(resolved, nodes, files, by=("kind",)), "file-edges")
    open_ = materialize(G.unresolved_by_file(resolved, files, by=("kind",)), "unresolved")
    deps = [r for r in chosen if r["verification"]["kind"] == "deps"]
    graph = [r for r in chosen if r["verification"]["kind"] != "deps"]
    errors: dict[str, str] = {}

    def run(laws: list[dict]) -> list[tuple[DataFrame, list[int]]]:
        """Findings of some rules, and what they leave unresolved: all dependency rules read the edges once."""
        if len(laws) > 1 and laws == deps:
            parts = [dependency_findings(pairs, files, r, paths) for r in laws]
            return [(materialize(reduce(DataFrame.unionByName, parts), "findings"), unresolved_in_scopes(open_, laws, paths))]
        law = laws[0]
        if law["verification"]["kind"] == "deps":
            return [(materialize(dependency_findings(pairs, files, law, paths), "findings"), unresolved_in_scopes(open_, [law], paths))]
        return [(materialize(graph_findings(pairs, files, law, paths), "findings"), [0])]

    def tried(laws: list[dict]) -> list[tuple[DataFrame, list[int]]]:
        try:
            return run(laws)
        except Exception as e:  # one rule's fault must not hide the others' results
            if len(laws) > 1:
                return [part for r in laws for part in tried([r])]
            errors[laws[0]["id"]] = f"engine-error: {str(e).splitlines()[0][:200]}"
            return []

    # independent runs share the cluster
    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        done = [part for parts in pool.map(tried, [*([deps] if deps else []), *([r] for r in graph)]) for part in parts]
    findings = reduce(DataFrame.unionByName, [d for d, _ in done]) if done else spark.createDataFrame([], FINDING)
    failed = {r["rule_id"] for r in findings.select("rule_id").distinct().collect()}  # at most a row for each rule
    n_open = dict(zip([r["id"] for r in deps if r["id"] not in errors], [n for _, ns in done for n in ns]))
    statuses = []
    for r in chosen:
        rid = r["id"]
        if rid in errors:
            statuses.append((rid, "skipped", errors[rid]))
        elif rid in failed:
            statuses.append((rid, "failed", None))
        elif n_open.get(rid):
            statuses.append((rid, "unknown", f"evaluated with {n_open[rid]} unresolved reference(s)"))
        else:
            statuses.append((rid, "passed", None))
    return Report(findings, spark.createDataFrame(statuses, STATUS))


def parse_fail_on(raw: str | bool | None) -> str | None:
    """The severity from which a finding fails a run: error by default, None if it is no severity."""
    return "error" if raw is None or raw is True else raw if raw in RANKS else None


def exit_code(report: Report, fail_on: str = "error", strict: bool = False) -> int:
    """1 with a finding of that severity, else 4 if strict and a rule was skipped, else 0."""
    if not report.findings.filter(severity_rank() >= RANKS[fail_on]).isEmpty():
        return 1
    return 4 if strict and not report.statuses.filter("status = 'skipped'").isEmpty() else 0


def sarif_results(findings: DataFrame, cap: int = SARIF_CAP) -> DataFrame:
    """ruleId, level, text, uri, start_line, fingerprint: the first ``cap`` by severity, then rule, place and detail."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    top = findings.orderBy(F.desc(severity_rank()), "rule_id", "repo", "file", "line", "detail").limit(cap)
    text = F.when(F.col("detail").isNotNull(), F.concat_ws(" ", "message", "detail")).otherwise(F.col("message"))
    return top.select(
        F.col("rule_id").alias("ruleId"), level.alias("level"), text.alias("text"), relative_uri(F.col("file")).alias("uri"),
        F.coalesce("line", F.lit(1)).alias("start_line"), fingerprint().alias("fingerprint"), severity_rank().alias("rank"), "repo", "file", "line",
    )


def to_sarif(report: Report, rules: list[dict], version: str = "1.0.0", tool: str = "strataline") -> dict:
    """A SARIF 2.1.0 log of the report: at most SARIF_CAP results are brought to the driver."""
    total = report.findings.count()
    rows = sarif_results(report.findings).orderBy(F.desc("rank"), "ruleId", "repo", "file", "line", "text").collect()
    skipped = report.statuses.filter("status = 'skipped'").orderBy("rule_id").collect()
    notes = [f"Rule {s['rule_id']} not evaluated: {s['detail']}" for s in skipped]
    if total > SARIF_CAP:
        notes.append(f"Truncated {total - SARIF_CAP} findings (cap {SARIF_CAP})")
    results = [
        {
            "ruleId": r["ruleId"], "level": r["level"], "message": {"text": r["text"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"]}}}],
            "partialFingerprints": {f"{tool}/v1": r["fingerprint"]},
        }
        for r in rows
    ]
    known = [{"id": r["id"], "name": r["id"].replace("~", "_"), "shortDescription": {"text": r.get("title") or r["id"]}, "fullDescription": {"text": r.get("prose") or ""}, "properties": {"tags": [r["verification"]["kind"]]}} for r in rules]
    failed = report.statuses.filter("status = 'failed'").isEmpty()
    return {
        "$schema": "https://json.schemastore.org/sarif-2.1.0.json",
        "version": "2.1.0",
        "runs": [{"tool": {"driver": {"name": tool, "semanticVersion": version, "rules": known}}, "results": results, "invocations": [{"executionSuccessful": failed, "toolExecutionNotifications": [{"level": "warning", "message": {"text": n}} for n in notes]}]}],
    }


def in_order(findings: DataFrame) -> DataFrame:
    """All findings by severity, then rule, place and detail."""
    return findings.orderBy(F.desc(severity_rank()), "rule_id", "repo", "file", "line", "detail", "message")


def markdown_rows(findings: DataFrame) -> DataFrame:
    """row: a line of the table of findings for each of them, in order. A distributed table, for a report of any size."""
    line = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")
    text = lambda c: F.coalesce(c, F.lit("None"))
    return in_order(findings).select(F.concat(F.lit("| `"), text("rule_id"), F.lit("` | "), text("severity"), F.lit(" | `"), text("file"), line, F.lit("` |")).alias("row"))


def json_rows(findings: DataFrame) -> DataFrame:
    """row: one JSON object for each finding, in order. A distributed table, for a report of any size."""
    return in_order(findings).select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("row"))


def to_markdown(report: Report, limit: int | None = None) -> str:
    """A summary, a table of findings and the rules that were not evaluated.

    All findings by default, which the driver then holds as text; with a limit the first ones, and a notice of how many are left out.
    """
    s = report.summary().first()
    lines = ["## Rule verification", "", f"**{s['passed']}** passed · **{s['failed']}** failed · **{s['skipped']}** skipped · **{s['unknown']}** unknown", ""]
    table = markdown_rows(report.findings)
    rows = [r["row"] for r in (table if limit is None else table.limit(limit)).toLocalIterator()]
    left_out = 0 if limit is None else report.findings.count() - len(rows)
    if rows or left_out:
        lines += ["### Findings", "", "| Rule | Severity | Location |", "| :-- | :-- | :-- |", *rows, ""]
    if left_out:
        lines += [f"{left_out} more findings are left out (limit {limit}).", ""]
    skipped = report.statuses.filter("status = 'skipped'").orderBy("rule_id").collect()
    if skipped:
        lines += ["### Not evaluated", ""] + [f"- `{r['rule_id']}`: {r['detail']}" for r in skipped] + [""]
    return "\n".join(lines)


def to_json(report: Report) -> str:
    """The whole report as one JSON document, which the driver holds as text; see json_rows for very many findings."""
    return json.dumps(
        {
            "schemaVersion": 1, "summary": report.summary().first().asDict(), "findings": [json.loads(r["row"]) for r in json_rows(report.findings).toLocalIterator()],
            "statuses": [r.asDict() for r in report.statuses.orderBy("rule_id").collect()],
        },
        ensure_ascii=False, indent=2,
    )
