"""Pairs within groups of any size, without one task ever holding a group.

Members are dealt to chunks; each unordered pair of chunks becomes one row, keyed so that the
rows of one group spread over all tasks. The rows of a group of n members are at most
(n / chunk)^2 / 2, each of at most two chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.references import salted_join


def chunk_pairs(members: DataFrame, group: list[str], item: str, size: DataFrame, chunk: int, key: Column) -> DataFrame:
    """Rows group..., left, right (sorted arrays of items); where both are one chunk, right is null.

    members: group..., item, unique. size: group..., n_items of the groups that are wanted.
    ``key`` is a hash of the item, by which it is dealt to a chunk.
    """
    n_chunks = F.ceil(F.col("n_items") / F.lit(float(chunk))).cast("int")
    dealt = salted_join(members, size.select(*group, n_chunks.alias("_chunks"), F.col("n_items").alias("n_refs")), group, item)
    dealt = dealt.withColumn("_own", F.pmod(key, F.col("_chunks")).cast("int"))
    # chunk i goes to each pair {i, j}; the pair's key spreads them
    met = dealt.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = met.select(*group, F.least("_own", "_met").alias("_lo"), F.greatest("_own", "_met").alias("_hi"), (F.col("_own") > F.col("_met")).alias("_second"), item)
    gathered = met.groupBy(*group, "_lo", "_hi").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_second"), F.col(item)))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("_second"), F.col(item)))).alias("right"),
    )
    return gathered.select(*group, "left", F.when(F.col("_lo") != F.col("_hi"), F.col("right")).alias("right"))


def pairs_of_arrays(df: DataFrame, keep: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keep..., a, b with a < b: each pair within ``left``, or between ``left`` and ``right`` if that is set."""
    first = df.select(*keep, "left", "right", F.posexplode("left").alias("_pos", "_x"))
    other = F.when(F.col("right").isNull(), F.slice("left", F.col("_pos") + 2, F.greatest(F.size("left"), F.lit(1)))).otherwise(F.col("right"))
    both = first.select(*keep, "_x", F.explode(other).alias("_y"))
    return both.select(*keep, F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b))
