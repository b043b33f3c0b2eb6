"""Pipelines: extraction of source text, an incremental index build, a streamed count."""

import uuid

from pyspark.sql import functions as F

from strataline.plans.index_build import build_index, read_index
from strataline.session import shared_folder, table
from strataline.sources.trees import extract_files, lang_for_path
from strataline.streaming.watch import stream_counts


def _sources(spark, sf_dir):
    """Documents that are source code, as files of one tree."""
    docs = table(spark, sf_dir, "documents", "doc_id", "kind", "path", "text").filter("kind = 'source_code' and text is not null and path is not null")
    docs = docs.withColumn("path", F.concat_ws("/", F.col("doc_id").cast("string"), "path")).withColumn("lang", lang_for_path("path")).filter("lang is not null")
    return docs.select("doc_id", "path", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "text")


def s4_extract(spark, sf_dir):
    """Definitions and references found in each source document."""
    found = extract_files(_sources(spark, sf_dir))
    return found.select("path", "lang", F.size("symbols").alias("n_symbols"), F.size("refs").alias("n_refs"))


def g22_build_index(spark, sf_dir):
    """Two builds over source documents, the second with the even ones left out and the fifths changed: counts of the second."""
    store = f"{shared_folder(spark)}/strataline/index-{uuid.uuid4().hex}"
    src = _sources(spark, sf_dir)
    build_index(spark, store, src.drop("doc_id"))
    later = src.filter("doc_id % 2 = 1").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("hash")))
    counts = build_index(spark, store, later.drop("doc_id"))
    n = read_index(spark, store)["files"].count()
    return spark.createDataFrame([(counts["new"], counts["changed"], counts["unchanged"], counts["removed"], n)], '"new" long, changed long, unchanged long, removed long, files long'.replace('"', "`"))


def st_streamed_counts(spark, sf_dir):
    """Touches per repository, counted by a stream over the table's files."""
    base = f"{shared_folder(spark)}/strataline/stream-{uuid.uuid4().hex}"
    return stream_counts(spark, f"{sf_dir}/commit_files.parquet", "sha string, ts long, path string, added int, deleted int, repo string", ["repo"], f"{base}/out", f"{base}/state")


QUERIES = {f.__name__: f for f in (s4_extract, g22_build_index, st_streamed_counts)}
_SRC = """src as (select doc_id, doc_id || '/' || path as path from documents where kind = 'source_code' and text is not null and path is not null
  and regexp_matches(lower(path), '\\.(py|pyi|js|jsx|mjs|cjs|ts|tsx|mts|cts)$'))"""
SQL = {
    "g22_build_index": f"""with {_SRC} select 0::bigint as "new", count_if(doc_id % 2 = 1 and doc_id % 5 = 0)::bigint as changed, count_if(doc_id % 2 = 1 and doc_id % 5 <> 0)::bigint as unchanged,
      count_if(doc_id % 2 = 0)::bigint as removed, count_if(doc_id % 2 = 1)::bigint as files from src""",
    "st_streamed_counts": "select repo, count(*) as n from commit_files group by repo",
}
