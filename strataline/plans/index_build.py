"""Building and refreshing the index: files, nodes, edges and embeddings as Parquet tables.

Unchanged files (by content hash) keep their rows and are not parsed again; removed ones
take their rows along. Ids are hashes of place and name, so a retried task gives the same
ids. A build is written beside the current one and becomes current by a pointer file, which
is replaced in one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.text import embed_texts
from strataline.operators.code_graph import resolve_calls
from strataline.sources.trees import extract_files

TABLES = {
    "files": "id long, path string, hash string, lang string, repo string",
    "nodes": "id long, file_id long, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, parent_id long, signature string",
    "edges": "id long, src_node_id long, src_file_id long, dst_name string, dst_node_id long, kind string, line int",
    "node_embeddings": "node_id long, dim int, model string, vec array<float>",
}
VERSION = "1"
#: A file above the size limit of the source is listed as seen, though not read, so its rows stay.
STATES = ("new", "changed", "unchanged", "removed")


def diff_files(old: DataFrame, new: DataFrame, key: list[str], seen: DataFrame | None = None) -> DataFrame:
    """key..., state of each file of either side. ``seen``: keys that still exist but are not in ``new``; they stay as they are."""
    o = old.select(*key, F.col("hash").alias("old_hash"), F.lit(True).alias("in_old"))
    n = new.select(*key, F.col("hash").alias("new_hash"), F.lit(True).alias("in_new"))
    both = o.alias("o").join(n.alias("n"), [F.expr(f"o.`{k}` <=> n.`{k}`") for k in key], "full")
    both = both.select(*(F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in key), "old_hash", "new_hash", "in_old", "in_new")
    gone = F.lit("removed")
    if seen is not None:
        both = both.join(seen.select(*key).distinct().withColumn("still", F.lit(True)), key, "left")
        gone = F.when(F.col("still"), F.lit("unchanged")).otherwise(F.lit("removed"))
    state = F.when(F.col("in_old").isNull(), F.lit("new")).when(F.col("in_new").isNull(), gone).when(F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit("unchanged")).otherwise(F.lit("changed"))
    return both.select(*key, state.alias("state"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, store: str) -> str | None:
    """Folder of the current build, or None; another version of the layout counts as none."""
    fs, at = _fs(spark, f"{store}/CURRENT")
    if not fs.exists(at):
        return None
    version, _, name = spark.read.text(f"{store}/CURRENT").first()[0].partition(" ")
    return f"{store}/{name}" if version == VERSION else None


def read_index(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    at = current(spark, store)
    return {t: spark.read.schema(ddl).parquet(f"{at}/{t}") if at else spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}


def _publish(spark: SparkSession, store: str, name: str) -> None:
    """Make a build the current one: the pointer is written beside and renamed over the old one, so a reader finds either."""
    jvm = spark.sparkContext._jvm
    fs, tmp = _fs(spark, f"{store}/.CURRENT-{name}")
    out = fs.create(tmp, True)
    out.write(bytearray(f"{VERSION} {name}\n".encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{store}/CURRENT")), how)


def drop_old_builds(spark: SparkSession, store: str) -> int:
    """Remove all builds but the current one; call it when no reader is left on an older one. Returns how many went."""
    now = current(spark, store)
    fs, at = _fs(spark, store)
    old = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("build-") and now is not None and x.getPath().getName() != now.rpartition("/")[2]]
    for path in old:
        fs.delete(path, True)
    return len(old)


def build_index(spark: SparkSession, store: str, sources: DataFrame, repo: str = "", seen: DataFrame | None = None) -> dict[str, int]:
    """Refresh the index from ``sources`` (path, lang, hash, text); returns counts of the build."""
    old = read_index(spark, store)
    state = diff_files(old["files"], sources, ["path"], seen).persist()
    todo = sources.join(state.filter("state in ('new', 'changed')").select("path"), "path", "left_semi")
    keep = old["files"].join(state.filter("state = 'unchanged'").select("path"), "path", "left_semi")
    parsed = extract_files(todo).withColumn("file_id", F.xxhash64(F.lit(repo), "path")).persist()

    files = keep.unionByName(parsed.select(F.col("file_id").alias("id"), "path", "hash", "lang", F.lit(repo).alias("repo")))
    at = parsed.select("file_id", F.posexplode("symbols").alias("pos", "s"))
    node_id = lambda pos: F.xxhash64("file_id", F.lit("node"), pos)
    nodes = at.select(
        node_id(F.col("pos")).alias("id"), "file_id", "s.name", "s.kind", "s.start_line", "s.end_line", "s.start_byte", "s.end_byte",
        F.when(F.col("s.parent").isNotNull(), node_id(F.col("s.parent"))).alias("parent_id"), "s.signature",
    )
    refs = parsed.select("file_id", F.posexplode("refs").alias("pos", "r"))
    edges = refs.select(
        F.xxhash64("file_id", F.lit("edge"), "pos").alias("id"), F.when(F.col("r.owner").isNotNull(), node_id(F.col("r.owner"))).alias("src_node_id"),
        F.col("file_id").alias("src_file_id"), F.col("r.name").alias("dst_name"), F.lit(None).cast("long").alias("dst_node_id"), "r.kind", "r.line",
    )
    text = F.concat_ws(" ", "kind", "name", "signature")
    vectors = embed_texts(nodes.select(F.col("id").alias("node_id"), text.alias("text")), "node_id", "text")
    kept = keep.select(F.col("id").alias("file_id"))
    nodes_all = old["nodes"].join(kept, "file_id", "left_semi").unionByName(nodes)
    edges_all = old["edges"].join(kept.withColumnRenamed("file_id", "src_file_id"), "src_file_id", "left_semi").unionByName(edges)
    vectors_all = old["node_embeddings"].join(old["nodes"].join(kept, "file_id", "left_semi").select(F.col("id").alias("node_id")), "node_id", "left_semi").unionByName(vectors)

    name = f"build-{uuid.uuid4().hex}"
    files.write.parquet(f"{store}/{name}/files")
    nodes_all.write.parquet(f"{store}/{name}/nodes")
    new_files, new_nodes = spark.read.parquet(f"{store}/{name}/files"), spark.read.parquet(f"{store}/{name}/nodes")
    # targets may be gone or new: every call is resolved again
    resolved = resolve_calls(edges_all.withColumn("dst_node_id", F.lit(None).cast("long")), new_nodes, new_files).withColumn("dst_node_id", F.col("target"))
    resolved.select(*(c.split()[0] for c in TABLES["edges"].split(", "))).write.parquet(f"{store}/{name}/edges")
    vectors_all.write.parquet(f"{store}/{name}/node_embeddings")
    _publish(spark, store, name)
    counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    out = {s: counts.get(s, 0) for s in STATES}
    out |= {"indexed": out["new"] + out["changed"], "nodes": parsed.select(F.sum(F.size("symbols"))).first()[0] or 0, "edges": parsed.select(F.sum(F.size("refs"))).first()[0] or 0}
    state.unpersist()
    parsed.unpersist()
    return out
