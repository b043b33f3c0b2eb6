"""History analytics over commit touches (repo, sha, ts, path, added, deleted)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.operators.blocks import chunk_pairs, pairs_of_arrays
from strataline.session import materialize, shared_folder

#: Paths of a commit in one chunk when pairs are made.
CHUNK = 128


def window(touches: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Touches with since <= ts < until (epoch seconds); a null ts is outside any bound."""
    if since is not None:
        touches = touches.filter(F.col("ts") >= since)
    return touches if until is None else touches.filter(F.col("ts") < until)


def commit_log(touches: DataFrame, path: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """repo, sha, ts, added, deleted per commit, for one path or all; order by ts to get a log."""
    some = window(touches, since, until)
    some = some.filter(F.col("path") == path) if path is not None else some
    return some.groupBy("repo", "sha").agg(F.min("ts").alias("ts"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def churn(touches: DataFrame, since: int | None = None, prefix: str | None = None) -> DataFrame:
    """repo, path, commits: distinct commits per path, for paths at or under ``prefix``."""
    some = window(touches, since)
    if prefix:
        root = prefix.rstrip("/")
        some = some.filter((F.col("path") == root) | F.col("path").startswith(root + "/"))
    return some.select("repo", "path", "sha").distinct().groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"))


def co_changes(touches: DataFrame, since: int | None = None, min_support: int = 1) -> DataFrame:
    """repo, a, b, count: commits that touch both paths, a < b in code-point order.

    Paths below the least support are in no pair and drop out first; large commits are cut
    to chunks of paths, whose pairs are made by separate tasks.
    """
    one = window(touches, since).select("repo", "sha", "path").distinct()
    if min_support > 1:
        often = one.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
        one = one.join(often.select("repo", "path"), ["repo", "path"], "left_semi")
    one = materialize(one, "touches")
    sizes = one.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
    rows = chunk_pairs(one, ["repo", "sha"], "path", sizes, CHUNK, F.xxhash64("path"))
    return pairs_of_arrays(rows, ["repo"]).groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_support)


def ranked_co_changes(pairs: DataFrame, limit: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """Pairs by count, most first, then by paths; at most ``limit`` of them, or of each ``scope`` (as repo)."""
    order = [F.desc("count"), *(["repo"] if not scope else []), "a", "b"]
    if limit is None or not scope:
        out = pairs.orderBy(*order)
        return out if limit is None else out.limit(limit)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit)


def with_shallow(result: DataFrame, shallow: bool | None) -> DataFrame:
    """A result of the history with the flag that says whether the clone lacks older commits; null if it is not known."""
    return result.withColumn("shallow", F.lit(shallow).cast("boolean"))


def last_touch(touches: DataFrame) -> DataFrame:
    """repo, path, sha, ts of the newest commit; of equal times the greatest sha."""
    best = touches.groupBy("repo", "path").agg(F.max(F.struct("ts", "sha")).alias("m"))
    return best.select("repo", "path", "m.sha", "m.ts")


def head_of(touches: DataFrame) -> str | None:
    """A state mark of the history: it changes when a commit is added. Null without commits."""
    row = touches.select("repo", "sha").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("repo", "sha").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['s']}" if row["n"] else None


def cache_key(name: str, **options) -> str:
    return name + ":" + json.dumps(options, sort_keys=True, separators=(",", ":"))


def read_through(touches: DataFrame, key: str, compute: Callable[[], DataFrame], folder: str | None = None, head: str | None = None) -> DataFrame:
    """A result kept as Parquet under its key, valid while the head is the same.

    One entry per key: a newer head replaces it. Without a head the cache is passed by.
    """
    spark = touches.sparkSession
    head = head if head is not None else head_of(touches)
    if head is None:
        return compute()
    base = f"{folder or shared_folder(spark) + '/strataline/cache'}/{abs(hash_text(key)):x}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{base}/{head}"
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
        for old in fs.listStatus(at):
            if old.getPath().getName() != head:
                fs.delete(old.getPath(), True)
    return spark.read.parquet(path)


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
