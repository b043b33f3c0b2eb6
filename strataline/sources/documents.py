"""Markdown trees, payload and log files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), text of every *.md under a folder."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return raw.select(F.substring(full, len(root.rstrip("/")) + 2, 1_000_000).alias("path"), F.col("value").alias("text"))


def context_log(spark: SparkSession, path: str) -> DataFrame:
    """at, file, ruleIds of an append-only log; malformed lines become nulls, the rest is kept."""
    return spark.read.schema("at string, file string, ruleIds array<string>").json(path)


def slice_text(text: str, start: int, end: int) -> str:
    """Part of a source by character offsets; empty where they make no sense."""
    return text[start:end] if 0 <= start <= end else ""
