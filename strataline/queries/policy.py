"""Path policy: globs, scopes, prefixes, actions against rules."""

from pyspark.sql import functions as F

from strataline import model
from strataline.functions.paths import glob_regex, in_scope, under
from strataline.model import sql
from strataline.operators.policy import BLOCKING, check_actions, check_payloads, coverage, scope_counts
from strataline.sources.rules import rules_frame


def _rule(rid: str, scope: list[str], enforcement: str, line: int) -> dict:
    return {"id": rid, "title": rid, "severity": "error", "scope": scope, "prose": f"keep {rid}", "enforcement": enforcement, "source": {"file": "RULES.md", "line": line}, "verification": {"kind": "path", "rule": {}}}


RULES = [
    _rule("core", ["src/core/**", "!src/core/**/*.{js,cjs}"], BLOCKING, 3),
    _rule("tests", ["test{,s}/**/*.py"], "context", 9),
    _rule("short", ["**/[a-d]?????.ts"], BLOCKING, 12),
    _rule("all", [], "context", 20),
]


def pr7_under(spark, sf_dir):
    return model.files(spark, sf_dir).filter(under(F.col("path"), ["src/core/", "lib"])).select("id", "path")


def pr8_glob(spark, sf_dir):
    return model.files(spark, sf_dir).select("id", F.col("path").rlike(glob_regex("**/{core,api}/*.[!t]s")).alias("hit"))


def pr9_scope(spark, sf_dir):
    return model.files(spark, sf_dir).filter(in_scope(F.col("path"), RULES[0]["scope"])).select("id", "path")


def j14_scope_counts(spark, sf_dir):
    return scope_counts(model.files(spark, sf_dir), RULES)


def g19_check(spark, sf_dir):
    """Every file as the target of an action, before it for even ids and after it for odd ones."""
    event = F.when(F.col("id") % 2 == 0, F.lit("PreToolUse")).otherwise(F.lit("PostToolUse"))
    out = check_actions(model.files(spark, sf_dir).withColumn("event", event), RULES)
    return out.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("blocked_by", ",").alias("blocked_by"), "verdict")


def s15_payloads(spark, sf_dir):
    payload = F.to_json(F.struct(F.struct(F.col("path").alias("file_path")).alias("tool_input")))
    p = model.files(spark, sf_dir).select("id", payload.alias("payload"), F.lit("PreToolUse").alias("event"))
    return check_payloads(p, RULES).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def a13_coverage(spark, sf_dir):
    """Rules whose scope holds a file, of all rules."""
    return coverage(rules_frame(spark, RULES), j14_scope_counts(spark, sf_dir))


QUERIES = {f.__name__: f for f in (pr7_under, pr8_glob, pr9_scope, j14_scope_counts, g19_check, s15_payloads, a13_coverage)}

_GLOB = "^(?:[^/]*/)*(?:core|api)/[^/]*\\.[^t]s$"
_CORE = "(regexp_matches(path, '^src/core/') and not regexp_matches(path, '^src/core/.*\\.(js|cjs)$'))"
_TESTS = "regexp_matches(path, '^tests?/(.*/)?[^/]*\\.py$')"
_SHORT = "regexp_matches(path, '(^|/)[a-d][^/]{5}\\.ts$')"
_HITS = f"hits as (select id, path, id % 2 = 0 as pre, {_CORE} as core, {_TESTS} as tests, {_SHORT} as short from f where path is not null)"
SQL = {
    "pr7_under": sql("select id, path from f where path = 'lib' or path like 'lib/%' or path = 'src/core' or path like 'src/core/%'"),
    "pr8_glob": sql(f"select id, regexp_matches(path, '{_GLOB}') as hit from f"),
    "pr9_scope": sql(f"select id, path from f where {_CORE}"),
    "j14_scope_counts": sql("select * from (select 'core' as rule_id, count_if(core)::bigint as n from hits union all select 'tests', count_if(tests) from hits union all select 'short', count_if(short) from hits union all select 'all', count(*) from hits) where n > 0", _HITS),
    "g19_check": sql(
        """select f.id, case when f.path is null then '' else concat_ws(',', case when core then 'core' end, case when tests then 'tests' end, case when short then 'short' end, 'all') end as matched,
        case when f.path is null or not pre then '' else concat_ws(',', case when core then 'core' end, case when short then 'short' end) end as blocked_by,
        case when pre and (core or short) then 'deny' else 'allow' end as verdict from f left join hits on hits.id = f.id""", _HITS),
    "s15_payloads": sql("select case when core or short then 'deny' else 'allow' end as verdict, count(*) as n from f left join hits on hits.id = f.id group by all", _HITS),
    "a13_coverage": sql("select 4::bigint as total, (max(core::int) + max(tests::int) + max(short::int) + 1)::bigint as seen from hits", _HITS),
}
