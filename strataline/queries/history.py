"""History: commit log, churn, co-change, last touch, cache, numstat text."""

from pyspark.sql import functions as F

from strataline.model import sql, touches
from strataline.operators.history import cache_key, churn, co_changes, commit_log, last_touch, ranked_co_changes, read_through, with_shallow
from strataline.sources.git import numstat_text, parse_name_only, parse_numstat

SINCE = 1_704_067_200  # 2024-01-01
PATH = "package.json"


def g14_log_for_path(spark, sf_dir):
    return commit_log(touches(spark, sf_dir), PATH, since=SINCE)


def a7_commit_sums(spark, sf_dir):
    return commit_log(touches(spark, sf_dir))


def g15_churn(spark, sf_dir):
    return churn(touches(spark, sf_dir))


def a5_churn_under_prefix(spark, sf_dir):
    return churn(touches(spark, sf_dir), since=SINCE, prefix="src/")


def g16_co_changes(spark, sf_dir):
    return co_changes(touches(spark, sf_dir))


def g18_cached_co_changes(spark, sf_dir):
    t = touches(spark, sf_dir)
    return read_through(t, cache_key("co-changes", since=None, data=sf_dir), lambda: co_changes(t))


def t6_top_co_changes(spark, sf_dir):
    """The ten most frequent pairs of each repository, with the flag of a shallow history."""
    top = ranked_co_changes(co_changes(touches(spark, sf_dir)), 10, ["repo"])
    return with_shallow(top, False)


def a6_co_changes_with_support(spark, sf_dir):
    return co_changes(touches(spark, sf_dir), since=SINCE, min_support=3)


def g17_last_touch(spark, sf_dir):
    return last_touch(touches(spark, sf_dir))


def g18_cached_churn(spark, sf_dir):
    t = touches(spark, sf_dir)
    return read_through(t, cache_key("churn", since=None, data=sf_dir), lambda: churn(t))


def t8_newest_commits(spark, sf_dir):
    log = commit_log(touches(spark, sf_dir))
    return log.orderBy(F.desc("ts"), "repo", "sha").limit(50)


def s9_numstat(spark, sf_dir):
    return parse_numstat(numstat_text(touches(spark, sf_dir))).select("repo", "sha", "ts", "path", "added", "deleted")


def s10_name_only(spark, sf_dir):
    t = touches(spark, sf_dir)
    text = t.groupBy("repo", "sha").agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("names"))
    return parse_name_only(text.select("repo", F.concat(F.lit("\x00"), F.col("sha"), F.lit("\n\n"), F.col("names"), F.lit("\n")).alias("log")))


QUERIES = {
    f.__name__: f
    for f in (g14_log_for_path, a7_commit_sums, g15_churn, a5_churn_under_prefix, g16_co_changes, a6_co_changes_with_support, g17_last_touch, g18_cached_churn, g18_cached_co_changes, t6_top_co_changes, t8_newest_commits, s9_numstat, s10_name_only)
}
_LOG = "select repo, sha, min(ts) as ts, sum(added)::bigint as added, sum(deleted)::bigint as deleted from t {} group by repo, sha"
_PAIRS = """select x.repo, x.path as a, y.path as b, count(*) as count
from t x join t y on x.repo = y.repo and x.sha = y.sha and x.path < y.path {} group by all"""
SQL = {
    "g14_log_for_path": sql(_LOG.format(f"where path = '{PATH}' and ts >= {SINCE}")),
    "a7_commit_sums": sql(_LOG.format("")),
    "g15_churn": sql("select repo, path, count(*) as commits from t group by all"),
    "g18_cached_churn": sql("select repo, path, count(*) as commits from t group by all"),
    "a5_churn_under_prefix": sql(f"select repo, path, count(*) as commits from t where ts >= {SINCE} and (path = 'src' or path like 'src/%') group by all"),
    "g16_co_changes": sql(_PAIRS.format("")),
    "g18_cached_co_changes": sql(_PAIRS.format("")),
    "t6_top_co_changes": sql(f"select *, false as shallow from (select *, (row_number() over (partition by repo order by count desc, a, b))::int as rank from ({_PAIRS.format('')})) where rank <= 10"),
    "a6_co_changes_with_support": sql(_PAIRS.format(f"where x.ts >= {SINCE} and y.ts >= {SINCE}") + " having count(*) >= 3"),
    "g17_last_touch": sql("select repo, path, sha, ts from (select *, row_number() over (partition by repo, path order by ts desc, sha desc) as r from t) where r = 1"),
    "t8_newest_commits": sql("select * from (" + _LOG.format("") + ") order by ts desc, repo, sha limit 50"),
    "s9_numstat": sql("select repo, sha, ts, path, added, deleted from t"),
    "s10_name_only": sql("select repo, sha, path from t"),
}
