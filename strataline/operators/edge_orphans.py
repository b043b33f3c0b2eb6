"""Orphan references of the code graph: edges whose targets are gone, unknown or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.references import orphan_references
from strataline.session import table, trimmed

#: Fields of an edge that refer to other rows, in the order in which ``first`` asks them.
FIELDS = ("dst_node_id", "dst_name", "src_file_id")


def edge_orphans(edges: DataFrame, nodes: DataFrame, files: DataFrame, pruned: DataFrame) -> DataFrame:
    """(edge_id, field, state, edge_at) for each orphan reference of an edge.

    The pair (dst_node_id, dst_name) is one composite reference under ``first`` match
    semantics: a set dst_node_id alone decides; where it is null, a call is matched by its
    name. src_file_id is a reference of its own. A dst_name of white space only is no
    reference. An edge's arrival is the earliest indexed_at of its id.

    States: ``deleted`` (the key is in ``pruned``), ``missing``, ``late``; a name is never
    late or deleted. Repeated rows count once, rows with a null id are no records, empty
    tables are allowed, extra columns are not read.
    """
    call = F.when(F.col("kind") == "call", F.when(trimmed("dst_name") != "", trimmed("dst_name")))
    flat = edges.filter(F.col("id").isNotNull()).select("id", "dst_node_id", "src_file_id", call.alias("dst_name"), "indexed_at")
    one = flat.groupBy("id").agg(*(F.min(c).alias(c) for c in ("dst_node_id", "dst_name", "src_file_id")), F.min("indexed_at").alias("edge_at"))
    # two references of an edge: its target, and its file
    blank = F.lit(None).cast("long")
    goes = F.struct("dst_node_id", F.when(F.col("dst_node_id").isNull(), F.col("dst_name")).alias("dst_name"), blank.alias("src_file_id"))
    comes = F.struct(blank.alias("dst_node_id"), F.lit(None).cast("string").alias("dst_name"), "src_file_id")
    refs = one.select(F.col("id").alias("edge_id"), "edge_at", F.explode(F.array(goes, comes)).alias("r")).select("edge_id", "edge_at", "r.*")
    # a name is known however late its node arrives
    names = nodes.select(trimmed("name").alias("name"), F.lit("0001-01-01").cast("timestamp").alias("indexed_at"))
    removed = lambda t: pruned.filter(F.col("table_name") == t).select(F.col("key_id").alias("id"))
    found = orphan_references(
        refs, [nodes.select("id", "indexed_at"), names, files.select("id", "indexed_at")], [("dst_node_id", "id"), ("dst_name", "name"), ("src_file_id", "id")],
        "edge_id", "first", "edge_at", "indexed_at", [removed("nodes"), None, removed("files")], keep_at=True,
    )
    field = F.element_at(F.array(*map(F.lit, FIELDS)), F.locate("1", F.col("mask")).cast("int"))
    return found.select("edge_id", field.alias("field"), "state", "edge_at")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_orphans(
        table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes", "id", "name", "indexed_at"),
        table(spark, sf_dir, "files", "id", "indexed_at"), table(spark, sf_dir, "pruned_rows", "table_name", "key_id"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("edge_id", "field", "state")


def p4_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans counted per field, state and month of the edge's arrival."""
    month = F.date_format("edge_at", "yyyy-MM").alias("month")
    return _orphans(spark, sf_dir).groupBy("field", "state", month).agg(F.count(F.lit(1)).alias("n"))
