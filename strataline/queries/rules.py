"""Rules over the file graph: dependency, cycle, reachability, a whole run and its SARIF."""

from pyspark.sql import functions as F

from strataline import model
from strataline.model import sql
from strataline.operators import code_graph as G
from strataline.operators.rules import dependency_findings, reach_findings
from strataline.plans.verify import exit_code, json_rows, markdown_rows, sarif_results, verify
from strataline.queries.traversal import _REACH, G_SQL, R, _tables
from strataline.sources.rules import rules_frame


def _law(rid: str, severity: str, kind: str, rule: dict, scope: list[str] | None = None) -> dict:
    return {"id": rid, "title": rid.replace("-", " "), "severity": severity, "scope": scope or [], "prose": f"rule {rid}", "enforcement": "gate", "source": {"file": "RULES.md", "line": 1}, "verification": {"kind": kind, "rule": rule}}


FEATURES = _law("no-cross-feature", "error", "deps", {"from": "^src/features/([^/]+)/", "to": "^src/features/", "toNot": "^src/features/$1/", "edgeKinds": ["call"]})
REQUIRED = _law("api-uses-core", "warn", "deps", {"from": "^src/api/", "to": "^src/core/", "type": "required"})
IMPORTS = _law("no-web-imports", "info", "deps", {"from": "^lib/", "to": "^web/", "edgeKinds": ["import"]})
NOWHERE = _law("no-such-folder", "info", "deps", {"from": "^no/such/folder/", "to": "^lib/"})
CYCLES = _law("no-cycles", "warn", "graph", {"circular": True})
REACH = _law("api-not-to-scripts", "error", "graph", {"reachable": True, "from": "^src/api/", "to": "^scripts/"})
RULES = [FEATURES, REQUIRED, IMPORTS, NOWHERE, CYCLES, REACH]


def _file_edges(spark, sf_dir, kinds=None):
    f, n, e = _tables(spark, sf_dir)
    return f, G.file_graph(e, n, f, kinds)


def g11_forbidden(spark, sf_dir):
    f, g = _file_edges(spark, sf_dir, ["call"])
    return dependency_findings(g, f, FEATURES)


def g11_required(spark, sf_dir):
    f, g = _file_edges(spark, sf_dir)
    return dependency_findings(g, f, REQUIRED).groupBy("rule_id", "severity", "repo", "file", "detail").agg(F.count(F.lit(1)).alias("n"))


def g9_reach_findings(spark, sf_dir):
    f, g = _file_edges(spark, sf_dir)
    return reach_findings(g, f, REACH).groupBy("repo", "file", "detail").agg(F.count(F.lit(1)).alias("n"))


def _run(spark, sf_dir):
    return verify(spark, RULES, model.files(spark, sf_dir), model.nodes(spark, sf_dir), model.edges(spark, sf_dir))


def g12_verify(spark, sf_dir):
    """Status of each rule."""
    return _run(spark, sf_dir).statuses.select("rule_id", "status")


def a11_verify_summary(spark, sf_dir):
    return _run(spark, sf_dir).summary()


def g13_exit_code(spark, sf_dir):
    report = _run(spark, sf_dir)
    return spark.createDataFrame([(exit_code(report), exit_code(report, "info", True))], "code int, strict int")


def k4_sarif_results(spark, sf_dir):
    """The results of a SARIF log of the forbidden rule, capped by severity."""
    return sarif_results(g11_forbidden(spark, sf_dir)).select("ruleId", "level", "text", "uri", "start_line", "fingerprint")


def k5_markdown(spark, sf_dir):
    """The table of findings of the markdown report, a row for each finding."""
    return markdown_rows(_run(spark, sf_dir).findings)


def k5_json(spark, sf_dir):
    """The findings of the JSON report, an object for each."""
    return json_rows(_run(spark, sf_dir).findings)


def p10_rules_table(spark, sf_dir):
    return rules_frame(spark, RULES).select("id", "severity", "verification.kind", "verification.rule.from", "verification.rule.to")


p10_rules_table.__name__ = "pr10_rules_table"
QUERIES = {f.__name__: f for f in (g11_forbidden, g11_required, g9_reach_findings, g12_verify, a11_verify_summary, g13_exit_code, k4_sarif_results, k5_markdown, k5_json, p10_rules_table)}

_FORBIDDEN = """bad as (
  select repo, src, dst, min(line) as line from g
  where regexp_matches(src, '^src/features/([^/]+)/') and regexp_matches(dst, '^src/features/')
    and not regexp_matches(dst, '^src/features/' || regexp_extract(src, '^src/features/([^/]+)/', 1) || '/') group by all
)"""
SQL = {
    "g11_forbidden": sql("select 'no-cross-feature' as rule_id, 'error' as severity, 'deps' as engine, repo, src as file, line, 'rule no-cross-feature' as message, '→ ' || dst as detail from bad", R, G_SQL, _FORBIDDEN),
    "g11_required": sql(
        """select 'api-uses-core' as rule_id, 'warn' as severity, repo, path as file, 'required dependency to ^src/core/ is missing' as detail, count(*) as n
        from f where regexp_matches(path, '^src/api/') and id not in (select src_id from g where regexp_matches(dst, '^src/core/')) group by all""", R, G_SQL),
    "g9_reach_findings": sql(
        """select repo, file, 'transitively reaches ' || dst as detail, count(*) as n from (
          select w.repo, o.path as file, h.path as dst, row_number() over (partition by w.repo, w.origin order by w.d, w.node) as k
          from w join f h on h.id = w.node join f o on o.id = w.origin where w.d > 0 and regexp_matches(h.path, '^scripts/')) where k = 1 group by all""",
        R, G_SQL,
        "w(repo, origin, node, d) as (select repo, id, id, 0 from f where regexp_matches(path, '^src/api/') union select w.repo, w.origin, g.dst_id, d + 1 from w join g on g.src_id = w.node and g.src_id <> g.dst_id where d < 12)",
        recursive=True),
    "g12_verify": sql(
        """select 'no-cross-feature' as rule_id, case when exists (select 1 from bad) then 'failed' when exists (select 1 from open where kind = 'call' and regexp_matches(path, '^src/features/([^/]+)/')) then 'unknown' else 'passed' end as status
        union all select 'api-uses-core', case when exists (select 1 from f where regexp_matches(path, '^src/api/') and id not in (select src_id from g where regexp_matches(dst, '^src/core/'))) then 'failed'
          when exists (select 1 from open where regexp_matches(path, '^src/api/')) then 'unknown' else 'passed' end
        union all select 'no-web-imports', case when exists (select 1 from open where kind = 'import' and regexp_matches(path, '^lib/')) then 'unknown' else 'passed' end
        union all select 'no-such-folder', 'passed'
        union all select 'no-cycles', case when exists (select 1 from ways w join ways v on v.a = w.b and v.b = w.a) then 'failed' else 'passed' end
        union all select 'api-not-to-scripts', case when exists (select 1 from ways w join f o on o.id = w.a join f h on h.id = w.b where regexp_matches(o.path, '^src/api/') and regexp_matches(h.path, '^scripts/')) then 'failed' else 'passed' end""",
        R, G_SQL, _FORBIDDEN, "open as (select f.path, r.kind from r join f on f.id = r.src_file_id where r.target is null)", _REACH, recursive=True),
    "k4_sarif_results": sql(
        """select 'no-cross-feature' as "ruleId", 'error' as level, 'rule no-cross-feature → ' || dst as text, src as uri, coalesce(line, 1) as start_line,
        'no-cross-feature:' || src || ':' || coalesce(line, 0) as fingerprint from (select * from bad order by repo, src, line, '→ ' || dst limit 5000)""", R, G_SQL, _FORBIDDEN),
    "pr10_rules_table": " union all ".join(
        "select {}, {}, {}, {}, {}".format(*(f"'{v}' as \"{k}\"" if v is not None else f'null as "{k}"' for k, v in (("id", r["id"]), ("severity", r["severity"]), ("kind", r["verification"]["kind"]), ("from", r["verification"]["rule"].get("from")), ("to", r["verification"]["rule"].get("to"))))) for r in RULES),
}
# the status of each rule, counted; no rule of this set is skipped
_n = "count_if(status = '{0}')::bigint as {0}"
SQL["a11_verify_summary"] = f"select count(*) as evaluated, {', '.join(_n.format(s) for s in ('passed', 'failed', 'unknown', 'skipped'))} from ({SQL['g12_verify']})"
