"""History text of git, as DataFrames.

Text is parsed by Spark, a block of commits in each row. ``read_log`` runs git on the driver
for one repository; on many, put their logs into files and read those.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _count(column: Column) -> Column:
    """A leading integer; - (binary) and anything else are 0."""
    return F.coalesce(F.regexp_extract(column, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def numstat_text(touches: DataFrame) -> DataFrame:
    """repo, log: touches written as numstat records, a commit in each row."""
    line = F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "path")
    each = touches.groupBy("repo", "sha").agg(F.min("ts").alias("ts"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    return each.select("repo", F.concat(F.lit("\x00"), F.col("sha"), F.lit("\x00"), F.coalesce(F.col("ts").cast("string"), F.lit("")), F.lit("\x00\n"), F.col("lines"), F.lit("\n")).alias("log"))


def parse_numstat(logs: DataFrame, log: str = "log") -> DataFrame:
    """Other columns, sha, ts, path, added, deleted from records NUL sha NUL ts NUL lines."""
    rest = [c for c in logs.columns if c != log]
    parts = F.split(log, "\x00")
    # parts: '', sha, ts, lines, sha, ts, lines ...
    at = F.sequence(F.lit(0), F.greatest((F.size(parts) - 1) / 3 - 1, F.lit(0)).cast("int"))
    records = F.filter(F.transform(at, lambda i: F.struct(F.get(parts, i * 3 + 1).alias("sha"), F.get(parts, i * 3 + 2).alias("ts"), F.get(parts, i * 3 + 3).alias("body"))), lambda r: r["sha"].isNotNull() & (r["sha"] != ""))
    each = logs.select(*rest, F.explode(records).alias("r"))
    lines = each.select(*rest, "r.sha", F.col("r.ts").try_cast("long").alias("ts"), F.explode(F.split("r.body", "\n")).alias("line"))
    cells = F.split("line", "\t", 3)
    whole = lines.filter(F.size(cells) == 3)
    return whole.select(*rest, "sha", "ts", cells[2].alias("path"), _count(cells[0]).alias("added"), _count(cells[1]).alias("deleted"))


def parse_name_only(logs: DataFrame, log: str = "log") -> DataFrame:
    """Other columns, sha, path from blocks NUL sha, blank line, names; a path once per commit."""
    rest = [c for c in logs.columns if c != log]
    blocks = logs.select(*rest, F.explode(F.filter(F.split(log, "\x00"), lambda b: b != "")).alias("block"))
    lines = F.split("block", "\n")
    names = F.array_distinct(F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x != ""))
    return blocks.select(*rest, F.get(lines, F.lit(0)).alias("sha"), F.explode(names).alias("path"))


def git(path: str, *args: str) -> str | None:
    """Output of a git command, or None if it fails."""
    try:
        done = subprocess.run(["git", "-C", path, "-c", "core.quotePath=false", *args], capture_output=True, text=True, errors="replace", check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return done.stdout


def head_sha(path: str) -> str | None:
    out = git(path, "rev-parse", "HEAD")
    return out.strip() if out else None


def is_shallow(path: str) -> bool:
    return (git(path, "rev-parse", "--is-shallow-repository") or "").strip() == "true"


def is_git_repo(path: str) -> bool:
    return (git(path, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def tracked_paths(path: str, *specs: str) -> list[str]:
    return [p for p in (git(path, "ls-files", "-z", "--", *specs) or "").split("\x00") if p]


def merge_base(path: str, base: str) -> str | None:
    out = git(path, "merge-base", base, "HEAD")
    return out.strip() if out else None


def changed_files(path: str, base: str) -> list[str]:
    """Paths added, copied, modified or renamed since the merge base; none without one."""
    at = merge_base(path, base)
    return [p for p in (git(path, "diff", "--name-only", "-z", "--diff-filter=ACMR", at, "HEAD") or "").split("\x00") if p] if at else []


def read_log(spark: SparkSession, path: str, repo: str, *args: str) -> DataFrame:
    """repo, sha, ts, path, added, deleted of one repository; empty where git fails."""
    out = git(path, "log", "--numstat", "--no-renames", "--format=%x00%H%x00%at%x00", *args) or ""
    return parse_numstat(spark.createDataFrame([(repo, out)], "repo string, log string"))
