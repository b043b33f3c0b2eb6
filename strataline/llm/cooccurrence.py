"""Items that appear together: pair counts over baskets and how far they exceed chance.

1. Items are counted, and given numbers, once per basket.
2. Bounds that follow from the wanted result drop items before any pair is made: a pair
   occurs at most as often as its rarer item, so an item below the least count is in no
   result, and the lift of a pair is at most baskets / count of its commoner item.
3. Baskets are cut to chunks of items. A pair of chunks is one row, so the pairs of a huge
   basket are made by many tasks, and an ordinary basket is just a basket of one chunk.
4. Pairs are counted with partial sums before the shuffle; scores are added to what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.blocks import chunk_pairs, pairs_of_arrays
from strataline.operators.references import salted_join
from strataline.session import materialize, table, trimmed

#: Items in a chunk: a row of two chunks gives at most this squared pairs.
CHUNK = 128


def associated_pairs(
    df: DataFrame, scope: str, basket: str, item: str, min_count: int = 1, min_lift: float | None = None, chunk: int = CHUNK
) -> DataFrame:
    """scope, a, b, n_ab, n_a, n_b, n_baskets, lift, jaccard: pairs a < b within each scope.

    A basket is a (scope, basket); items count once in it. lift = n_ab * n_baskets / (n_a * n_b).
    Rows with a null in any of the three columns do not count, nor do baskets of such rows only;
    a basket of one item counts as a basket. Items are compared as they are (strings in
    code-point order). Other columns are not read; an empty table gives an empty result.
    """
    one = df.select(F.col(scope).alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    one = materialize(one, "baskets")
    n_baskets = one.select("scope", "basket").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("n_baskets"))
    counts = materialize(one.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")), "counts")
    # one scope may hold most items, one item be in most pairs: both are dealt out
    held = counts.groupBy("scope").agg(F.count(F.lit(1)).alias("n_refs"))
    counts = salted_join(counts, n_baskets.join(held, "scope"), ["scope"], "item")
    fits = F.col("n") >= min_count
    if min_lift is not None:
        fits = fits & (F.col("n_baskets") >= F.col("n") * min_lift)
    # every item is kept as a key, with its fate, so that a hot one that is dropped is dealt out like any other
    items = materialize(counts.withColumn("fits", fits).withColumn("no", F.monotonically_increasing_id()), "items")
    numbered = salted_join(one, items.select("scope", "item", "fits", "no", F.col("n").alias("n_refs")), ["scope", "item"], "basket")
    members = materialize(numbered.filter("fits").select("scope", "basket", "no"), "members")
    sizes = members.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
    rows = chunk_pairs(members, ["scope", "basket"], "no", sizes, chunk, F.xxhash64("no"))
    pairs = pairs_of_arrays(rows, [], "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_count)
    pairs = materialize(pairs, "pairs")
    times = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n_refs"))
    left = items.select(F.col("no").alias("x"), "scope", F.col("item").alias("item_x"), F.col("n").alias("n_x"), "n_baskets").join(times("x"), "x")
    right = items.select(F.col("no").alias("y"), F.col("item").alias("item_y"), F.col("n").alias("n_y")).join(times("y"), "y")
    whole = salted_join(salted_join(pairs, left, ["x"], "y"), right, ["y"], "x")
    ahead = F.col("item_x") < F.col("item_y")
    pick = lambda s, t: F.when(ahead, F.col(s)).otherwise(F.col(t))
    out = whole.select(
        F.col("scope").alias(scope), pick("item_x", "item_y").alias("a"), pick("item_y", "item_x").alias("b"), "n_ab",
        pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "n_baskets",
    )
    if min_lift is not None:
        out = out.filter(F.col("n_ab") * F.col("n_baskets") >= min_lift * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")).cast("double")
    return out.withColumn("lift", lift).withColumn("jaccard", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab")))


def path_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, sha, path of commit_files, paths trimmed, blank ones null."""
    path = F.when(trimmed("path") != "", trimmed("path"))
    return table(spark, sf_dir, "commit_files", "repo", "sha", "path").select("repo", "sha", path.alias("path"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associated_pairs(path_touches(spark, sf_dir), "repo", "sha", "path", min_count=5, min_lift=4).select("repo", "a", "b")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of paths that shares a commit, with its counts and scores."""
    found = associated_pairs(path_touches(spark, sf_dir), "repo", "sha", "path")
    return found.withColumn("lift", F.round("lift", 6)).withColumn("jaccard", F.round("jaccard", 6))


_PAIRS = """
with t as (
  select distinct repo, sha, p as path
  from (select repo, sha, nullif(trim(path, chr(32) || chr(9) || chr(13) || chr(10)), '') as p from commit_files)
  where repo is not null and sha is not null and p is not null
),
n as (select repo, path, count(*) as n from t group by all),
c as (select repo, count(distinct sha) as n_baskets from t group by all),
ab as (
  select x.repo, x.path as a, y.path as b, count(*) as n_ab
  from t x join t y on x.repo = y.repo and x.sha = y.sha and x.path < y.path group by all
),
scored as (
  select ab.repo, a, b, n_ab, na.n as n_a, nb.n as n_b, n_baskets
  from ab join n na on na.repo = ab.repo and na.path = a join n nb on nb.repo = ab.repo and nb.path = b join c on c.repo = ab.repo
)
"""

QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
SQL = {
    "p1_found": _PAIRS + "select repo, a, b from scored where n_ab >= 5 and n_ab * n_baskets >= 4 * n_a * n_b",
    "p1_pairs": _PAIRS + """select *, round(n_ab * n_baskets / (n_a * n_b)::double, 6) as lift,
       round(n_ab / (n_a + n_b - n_ab)::double, 6) as jaccard from scored""",
}
