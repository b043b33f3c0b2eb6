"""The index tables as clean views: one row for each id, one spelling for each path and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.session import table, trimmed


def clean_path(column: str) -> Column:
    """Forward slashes, no doubled ones, no leading ./ and no white space at the ends; null if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(trimmed(column), r"\\", "/"), "/+", "/")
    path = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(path != "", path)


def clean_name(column: str) -> Column:
    return F.when(trimmed(column) != "", trimmed(column))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, hash, lang, repo."""
    raw = table(spark, sf_dir, "files", "id", "path", "hash", "lang", "repo").filter("id is not null")
    return raw.withColumn("path", clean_path("path")).groupBy("id").agg(*(F.min(c).alias(c) for c in ("path", "hash", "lang", "repo")))


_NODE = ("file_id", "name", "kind", "start_line", "end_line", "start_byte", "end_byte", "parent_id", "signature")


def nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """id and the columns asked for (all by default)."""
    columns = columns or _NODE
    raw = table(spark, sf_dir, "nodes", "id", *columns).filter("id is not null")
    if "name" in columns:
        raw = raw.withColumn("name", clean_name("name"))
    return raw.groupBy("id").agg(*(F.min(c).alias(c) for c in columns))


_EDGE = ("src_node_id", "src_file_id", "dst_name", "dst_node_id", "kind", "line")


def edges(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """id and the columns asked for (all by default)."""
    columns = columns or _EDGE
    raw = table(spark, sf_dir, "edges", "id", *columns).filter("id is not null")
    if "dst_name" in columns:
        raw = raw.withColumn("dst_name", clean_name("dst_name"))
    return raw.groupBy("id").agg(*(F.min(c).alias(c) for c in columns))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, sha, ts (seconds), path, added, deleted: one row for each commit and path; null counts are 0."""
    raw = table(spark, sf_dir, "commit_files").withColumn("path", clean_name("path"))
    raw = raw.filter("repo is not null and sha is not null and path is not null")
    seconds = F.when(F.col("ts") > 100_000_000_000, F.floor(F.col("ts") / 1000)).otherwise(F.col("ts"))
    count = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return raw.withColumn("ts", seconds.cast("long")).groupBy("repo", "sha", "path").agg(F.min("ts").alias("ts"), count("added"), count("deleted"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, kind, source, text of the documents."""
    return table(spark, sf_dir, "documents", "doc_id", "path", "kind", "source", "text")


_WS = "chr(32) || chr(9) || chr(13) || chr(10)"
_PATH = f"regexp_replace(regexp_replace(replace(trim(path, {_WS}), chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '')"

#: The same views in SQL: f, n, e and t.
SQL_VIEWS = f"""
f as materialized (
  select id, nullif(min({_PATH}), '') as path, min(hash) as hash, min(lang) as lang, min(repo) as repo
  from files where id is not null group by id
),
n as materialized (
  select id, min(file_id) as file_id, min(nullif(trim(name, {_WS}), '')) as name, min(kind) as kind, min(start_line) as start_line,
         min(end_line) as end_line, min(start_byte) as start_byte, min(end_byte) as end_byte, min(parent_id) as parent_id, min(signature) as signature
  from nodes where id is not null group by id
),
e as materialized (
  select id, min(src_node_id) as src_node_id, min(src_file_id) as src_file_id, min(nullif(trim(dst_name, {_WS}), '')) as dst_name,
         min(dst_node_id) as dst_node_id, min(kind) as kind, min(line) as line
  from edges where id is not null group by id
),
t as materialized (
  select repo, sha, path, min(ts) as ts, coalesce(max(added), 0)::bigint as added, coalesce(max(deleted), 0)::bigint as deleted
  from (select repo, sha, nullif(trim(path, {_WS}), '') as path, case when ts > 100000000000 then ts // 1000 else ts end as ts, added, deleted from commit_files)
  where repo is not null and sha is not null and path is not null group by repo, sha, path
)
"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join([SQL_VIEWS.strip(), *ctes]) + "\n" + body
