"""Recall: the nodes most similar to a text or a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.text import DIM, dot, embed_sparse


def recall_text(nodes: DataFrame, text: str, limit: int = 15, dim: int = DIM) -> DataFrame:
    """id, score: nodes by cosine of the lexical vectors of "kind name signature" and of the text, best first.

    Only entries that the text's vector has are joined, so nodes without a token in common
    are never scored; they would have 0 and fill up the list by id only if it is short.
    """
    spark = nodes.sparkSession
    query = embed_sparse(spark.createDataFrame([(0, text)], "q int, text string"), "q", "text", dim).select("bucket", F.col("weight").alias("w"))
    docs = embed_sparse(nodes.select("id", F.concat_ws(" ", "kind", "name", "signature").alias("text")), "id", "text", dim)
    scored = docs.join(F.broadcast(query), "bucket")  # at most dim rows
    top = scored.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))
    return top.orderBy(F.desc("score"), "id").limit(limit)


def recall_vector(embeddings: DataFrame, vector: list[float], limit: int = 15) -> DataFrame:
    """node_id, model, score: vectors of the same dim by dot product, best first. Repeated rows count once."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    ok = embeddings.filter((F.col("dim") == len(vector)) & (F.size("vec") == len(vector)) & ~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    scored = ok.select("node_id", "model", F.round(dot(F.col("vec"), q), 6).alias("score")).distinct()
    return scored.orderBy(F.desc("score"), "node_id", "model").limit(limit)
