"""The most similar vectors of every vector, by additive quantisation and exact reranking.

1. Usable vectors are brought to unit length. Equal vectors (a class) are coded once.
2. A quantiser is trained for each (model, dim) on a sample of at most about ``TRAIN`` of its
   classes; every class is coded and indexed. The cells of the index are the coarse centres;
   where more cells are needed they are split by the words of the first residual books, so
   that their number follows the data while what is trained does not.
3. A query visits its nearest cells. Cells are cut to blocks of members and of queries, so a
   cell that holds a third of all vectors is worked on by many tasks; no pair is skipped.
4. In a block, look-up tables score all members; the best of them are compared exactly, and
   then every other member whose score and code error allow it to come before the k-th of
   them. Where that leaves many, the query is compared with the whole block. The best of all
   blocks are the result, and members of classes are put back.

Jobs run while an index is made and while a search is planned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.llm.quantiser import BOOKS, WORDS, Quantiser, may_reach
from strataline.operators.references import salted_join
from strataline.session import materialize, table

#: Classes that a quantiser is trained on, about so many at most for each (model, dim): in one task, whatever the data.
TRAIN = 32_768
#: Members that a cell should have on average; the most coarse centres; a cell this many times larger is split by one more book, two at most.
CELL, MOST_COARSE, SPLIT = 768, 1_024, 8
#: Cells that a query visits, by the number of books that cells are split by.
PROBES = (6, 12, 24)
#: Members and queries in one block of a cell.
BLOCK = 8_192
#: Parts of a block whose best members show where the k-th of all may be, and how many more than k of them are compared first.
PARTS, MORE = 64, 4
#: Rows of the table of cells up to which it is sent to all tasks.
SENT_CELLS = 200_000
#: Bytes that the quantisers of all groups may take.
MOST_BYTES = 512 << 20
#: Share of a block's members from which a query is compared with all of them, and pairs compared at once below it.
WHOLE, PAIRS = 1 / 32, 16_384
#: Scores, and queries, held at once in a block.
SCORES, ASKED = 4_000_000, 512
#: More (model, dim) groups than this are refused, as each has a quantiser in memory.
MOST_GROUPS = 256

_CODED = "grp int, cls long, low long, n_nodes long, vec array<float>, cell int, codes binary, norm float, probes array<int>"
_FOUND = "cls long, other long, low long, cosine double"


def usable_vectors(df: DataFrame) -> DataFrame:
    """node_id, model, dim, vec: not null, of the stated length, finite, not all zero; repeated rows once.

    A node with several different vectors under one (model, dim) keeps the least of them.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("vec", lambda x: x != 0)
    ok = df.filter(F.col("node_id").isNotNull() & F.col("model").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & ~bad & some)
    return ok.groupBy("node_id", "model", "dim").agg(F.min("vec").alias("vec"))


def _unit(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compared(asks: np.ndarray, x: np.ndarray, wanted: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows, members, cosines of the wanted pairs (members x asks); all asks in ``many`` are multiplied with all members."""
    whole = np.flatnonzero(many)
    for k in range(0, len(whole), 128):
        rows = whole[k : k + 128]
        value = x @ asks[rows].T
        at, row = wanted[:, rows].nonzero()
        yield rows[row], at, value[at, row]
    some = np.flatnonzero(~many)
    if len(some):
        at, row = (wanted if len(some) == len(asks) else wanted[:, some]).nonzero()
        row = some[row]
        value = np.empty(len(row))
        for k in range(0, len(row), PAIRS):
            p = slice(k, k + PAIRS)
            value[p] = np.einsum("nd,nd->n", asks[row[p]], x[at[p]])
        yield row, at, value


def _best(rows: np.ndarray, at: np.ndarray, value: np.ndarray, lows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row, equal ones by the members' least node."""
    order = np.lexsort((lows[at], -value, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _nearest_members(near: np.ndarray, norms: np.ndarray, fits: np.ndarray, asks: np.ndarray, x: np.ndarray, ids: np.ndarray, lows: np.ndarray, own: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """rows, members, cosines: for each ask the k nearest members other than ``own``, at ``least`` or nearer.

    near: scores, members x asks.
    """
    m, parts = len(ids), (rows := np.empty(0, np.int64), rows, np.empty(0))
    floor = max(least - 1e-9, -1.5)
    if m > PARTS * 2:
        tops = near[: m - m % PARTS].reshape(PARTS, -1, near.shape[1]).max(axis=1)
        first = near >= np.partition(tops, PARTS - k - MORE, axis=0)[PARTS - k - MORE]
    else:
        first = np.ones(near.shape, bool)
    if least > -1:
        first &= may_reach(near, norms, fits, np.full(near.shape[1], least))
    goals = np.full(near.shape[1], least)
    for last in (m <= PARTS * 2, True):
        many = np.count_nonzero(first, axis=0) > max(WHOLE * m, 2 * PARTS)
        for rows, at, value in [*_compared(asks, x, first, many)]:
            value = np.round(value, 9)
            ok = (value >= floor) & (ids[at] != own[rows])
            parts = [np.concatenate(p) for p in zip(parts, (rows[ok], at[ok], value[ok]))]
        best = _best(*parts, lows, k)
        parts = [p[best] for p in parts]
        if last:
            return tuple(parts)
        full = np.bincount(parts[0], minlength=len(goals)) >= k
        kth = np.full(len(goals), np.inf)
        np.minimum.at(kth, parts[0], parts[2])
        goals = np.where(full, np.maximum(kth, least), least)
        first = may_reach(near, norms, fits, goals) & ~first
    raise AssertionError


class VectorIndex:
    """Coded classes of a table of vectors, see the module.

    vectors: node_id, model, dim, vec (other columns are not read). Unusable vectors are left
    out (see usable_vectors); an empty table gives empty results. Equal neighbours are ranked
    by the smaller node_id.
    """

    def __init__(self, vectors: DataFrame):
        self.spark = spark = vectors.sparkSession
        ok = usable_vectors(vectors)
        seed = 0
        while True:  # a class is known by a hash; another one is taken if two different vectors have the same
            ok2 = materialize(ok.withColumn("cls", F.xxhash64("model", "dim", "vec", F.lit(seed))), "vectors")
            whole = F.struct("model", "dim", "vec")
            each = materialize(ok2.groupBy("cls").agg(F.min(whole).alias("v"), F.max(whole).alias("w"), F.min("node_id").alias("low"), F.count(F.lit(1)).alias("n_nodes")), "classes")
            if each.filter("v <> w").isEmpty():
                break
            seed += 1
        self.members = ok2.select("cls", "node_id", "model", "dim")
        each = each.select("cls", "low", "n_nodes", "v.model", "v.dim", "v.vec")
        groups = each.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).limit(MOST_GROUPS + 1).collect()
        if len(groups) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups of model and dim")
        groups = sorted(groups, key=lambda g: (g["model"], g["dim"]))
        self.groups = {i: (g["model"], g["dim"], g["n"]) for i, g in enumerate(groups)}
        self.coded = spark.createDataFrame([], _CODED)
        if not groups:
            return
        shape = {}
        for i, (_, _, n) in self.groups.items():
            coarse = 2 ** round(np.log2(min(max(n / CELL, 1), MOST_COARSE)))
            over = n / CELL / coarse
            shape[i] = coarse, int(over >= SPLIT) + int(over >= SPLIT * WORDS)
        size = sum((shape[i][0] + BOOKS * WORDS) * d * 4 for i, (_, d, _) in self.groups.items())
        if size > MOST_BYTES:
            raise ValueError(f"quantisers of {size} bytes: more than {MOST_BYTES}")
        plan = spark.createDataFrame([(i, m, d, -(-n // TRAIN), *shape[i]) for i, (m, d, n) in self.groups.items()], "grp int, model string, dim int, every long, cells int, deep int")
        # at most MOST_GROUPS rows
        each = each.join(F.broadcast(plan), ["model", "dim"]).select("grp", "cls", "low", "n_nodes", "vec", "every", "cells", "deep")

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cls")
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            q = Quantiser.train(x, int(pdf["cells"].iloc[0]), int(pdf["deep"].iloc[0]))
            return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "model": [pickle.dumps((q.coarse, q.books, q.deep))]})

        sample = each.filter(F.pmod(F.xxhash64("cls", F.lit(11)), F.col("every")) == 0)
        trained = sample.groupBy("grp").applyInPandas(train, "grp int, model binary").collect()
        self.quantisers = spark.sparkContext.broadcast({r["grp"]: bytes(r["model"]) for r in trained})
        shared = self.quantisers

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Quantiser] = {}
            for b in batches:
                grp = b.column("grp").to_numpy()
                for g in np.unique(grp):
                    if g not in known:
                        known[g] = Quantiser(*pickle.loads(shared.value[int(g)]))
                    part = b.filter(pa.array(grp == g))
                    x = _unit(part.column("vec")).astype(np.float32)
                    cell, codes, norms = known[g].encode(x)
                    visits = known[g].probes(x, PROBES[known[g].deep]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grp[grp == g].astype(np.int32)), part.column("cls"), part.column("low"), part.column("n_nodes"),
                            part.column("vec"),
                            pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * visits.shape[1]), pa.array(visits.ravel())),
                        ],
                        names=["grp", "cls", "low", "n_nodes", "vec", "cell", "codes", "norm", "probes"],
                    )

        self.coded = materialize(each.select("grp", "cls", "low", "n_nodes", "vec").mapInArrow(encode, _CODED), "coded")

    def _search(self, queries: DataFrame, everywhere: bool, k: int, least: float) -> DataFrame:
        """cls, other, cosine: up to k other classes for each query class, best first found in blocks."""
        home = F.lit(0) if everywhere else F.col("cell")
        visit = F.array(F.lit(0)) if everywhere else F.col("probes")
        members = self.coded.select("grp", home.alias("at"), "cls", "low", "vec", "cell", "codes", "norm")
        visits = queries.select("grp", F.explode(visit).alias("at"), "cls", "vec")
        blocks = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK))).cast("int")
        grid = members.groupBy("grp", "at").agg(F.count(F.lit(1)).alias("m")).join(visits.groupBy("grp", "at").agg(F.count(F.lit(1)).alias("q")), ["grp", "at"])
        grid = materialize(grid.withColumn("m_blocks", blocks("m")).withColumn("q_blocks", blocks("q")), "grid")
        few = grid.count() <= SENT_CELLS

        def placed(df: DataFrame, n: str) -> DataFrame:
            cells = grid.select("grp", "at", F.col(n).alias("n_refs"), "m_blocks", "q_blocks")
            return df.join(F.broadcast(cells.drop("n_refs")), ["grp", "at"]) if few else salted_join(df, cells, ["grp", "at"], "cls")

        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
        left = placed(members, "m").withColumn("mb", deal("m_blocks")).withColumn("qb", every("q_blocks")).drop("m_blocks", "q_blocks")
        right = placed(visits, "q").withColumn("qb", deal("q_blocks")).withColumn("mb", every("m_blocks")).drop("m_blocks", "q_blocks")
        right = right.select(*(F.col(c).alias(f"q_{c}") for c in ("grp", "at", "mb", "qb", "cls", "vec")))
        shared = self.quantisers

        def score(key: tuple, have: pa.Table, ask: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[], [], [], []]
            if have.num_rows and ask.num_rows:
                q = Quantiser(*pickle.loads(shared.value[key[0].as_py()]))
                get = lambda t, c: t[c].combine_chunks()
                x, y = _unit(get(have, "vec")), _unit(get(ask, "q_vec"))
                ids, lows, asks = get(have, "cls").to_numpy(), get(have, "low").to_numpy(), get(ask, "q_cls").to_numpy()
                codes = np.frombuffer(b"".join(get(have, "codes").to_pylist()), np.uint8).reshape(-1, BOOKS)
                cell, norms = get(have, "cell").to_numpy(), get(have, "norm").to_numpy()
                fits = q.fits(x, cell, codes)
                centres, own = np.unique(q.centre_of(cell), return_inverse=True)
                step = max(1, min(ASKED, SCORES // len(ids)))
                for s in range(0, len(asks), step):
                    part, own_ids = y[s : s + step], asks[s : s + step]
                    small = part.astype(np.float32)
                    near = q.scores(q.tables(small), (q.coarse[centres] @ small.T)[own], codes, norms)
                    rows, at, value = _nearest_members(near, norms, fits, part, x, ids, lows, own_ids, k, least)
                    for o, v in zip(out, (own_ids[rows], ids[at], lows[at], value)):
                        o.append(v)
            if not out[0]:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["cls", "other", "low", "cosine"])
            return pa.table([np.concatenate(o) for o in out], names=["cls", "other", "low", "cosine"])

        keys = ["grp", "at", "mb", "qb"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(score, _FOUND)
        best = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "low"))
        return found.withColumn("rank", best).filter(F.col("rank") <= k).drop("rank")

    def neighbours(self, k: int, least: float = -1.0, every: int = 1, everywhere: bool = False) -> DataFrame:
        """node_id, other_id, model, dim, cosine, rank: the k most similar other nodes with a cosine of ``least`` or more.

        Queries are the nodes whose id is divisible by ``every``. ``everywhere`` scores all
        codes instead of those in the nearest cells: then the result is exact.
        """
        member = self.members
        if not self.groups:
            return self.spark.createDataFrame([], "node_id long, other_id long, model string, dim int, cosine double, rank int")
        # the k + 1 smallest nodes of a class are all that anyone can need of it
        place = F.row_number().over(Window.partitionBy("cls").orderBy("node_id"))
        first = member.select("cls", "node_id").withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
        copies = member.groupBy("cls").agg(F.count(F.lit(1)).alias("n_refs")).filter("n_refs > 1")
        lists = first.join(copies, "cls").groupBy("cls").agg(F.collect_list("node_id").alias("nodes"), F.max("n_refs").alias("n_refs"))
        asked = member.filter(F.col("node_id") % every == 0)
        equal = salted_join(asked, lists, ["cls"], "node_id")
        equal = equal.select("node_id", "model", "dim", F.explode("nodes").alias("other_id"), F.lit(1.0).alias("cosine")).filter("node_id <> other_id")
        # a class with more than k members fills its own lists
        queries = self.coded.filter(F.col("n_nodes") <= k)
        if every > 1:
            queries = queries.join(asked.select("cls").distinct(), "cls", "left_semi")
        near = materialize(self._search(queries, everywhere, k, least), "near")
        # a vector may be among the nearest of very many
        hubs = near.groupBy("other").agg(F.count(F.lit(1)).alias("n_refs"))
        named = first.groupBy(F.col("cls").alias("other")).agg(F.collect_list("node_id").alias("nodes")).join(hubs, "other")
        apart = salted_join(near, named, ["other"], "cls").join(asked, "cls").withColumn("other_id", F.explode("nodes"))
        both = equal.unionByName(apart.select("node_id", "model", "dim", "other_id", F.round("cosine", 9).alias("cosine"))).filter(F.col("cosine") >= least)
        rank = F.row_number().over(Window.partitionBy("node_id", "model", "dim").orderBy(F.desc("cosine"), "other_id"))
        return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex(table(spark, sf_dir, "node_embeddings", "node_id", "model", "dim", "vec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _index(spark, sf_dir).neighbours(5, least=0.9)
    return near.select(F.least("node_id", "other_id").alias("node_a"), F.greatest("node_id", "other_id").alias("node_b")).distinct()


def _rounded(near: DataFrame) -> DataFrame:
    return near.select("node_id", "model", "dim", "other_id", F.round("cosine", 6).alias("cosine"), "rank")


def p2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every vector, whatever their cosine, by the index."""
    return _rounded(_index(spark, sf_dir).neighbours(5))


def p2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors, whatever their cosine, for every node whose id is divisible by 50: exact, against all codes."""
    return _rounded(_index(spark, sf_dir).neighbours(5, every=50, everywhere=True))


def recall(index: VectorIndex, k: int, every: int) -> DataFrame:
    """model, dim, n_wanted, recall: how many of the k nearest the index finds, for nodes whose id is divisible by ``every``; ties count as found."""
    want = index.neighbours(k, every=every, everywhere=True).groupBy("node_id", "model", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("kth"))
    got = index.neighbours(k, every=every).join(want, ["node_id", "model", "dim"]).filter(F.col("cosine") >= F.col("kth") - 1e-7)
    hits = got.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("hits"))
    return want.groupBy("model", "dim").agg(F.sum("n").alias("n_wanted")).join(hits, ["model", "dim"], "left").select("model", "dim", "n_wanted", (F.coalesce("hits", F.lit(0)) / F.col("n_wanted")).alias("recall"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model and dim: whether the index finds at least 0.95 of the five nearest of all nodes whose id is divisible by 50."""
    return recall(_index(spark, sf_dir), 5, 50).select("model", "dim", "n_wanted", (F.col("recall") >= 0.95).alias("enough"))


QUERIES = {"p2_found": p2_found, "p2_all": p2_all, "p2_knn": p2_knn, "p2_recall": p2_recall}
# brute force: fit for tables up to some ten thousand vectors
_NEAR = """
with u as materialized (
  select node_id, model, dim, min(vec)::double[] as vec from node_embeddings
  where node_id is not null and model is not null and len(vec) = dim and list_bool_and(list_transform(vec, lambda x: isfinite(x))) and list_bool_or(list_transform(vec, lambda x: x <> 0))
  group by node_id, model, dim
),
near as (
  select a.node_id as x, b.node_id as y, a.model, a.dim, case when a.vec = b.vec then 1.0::double else round(list_cosine_similarity(a.vec, b.vec), 9) end as c
  from u a join u b on a.model = b.model and a.dim = b.dim and a.node_id <> b.node_id where {}
),
ranked as (select *, row_number() over (partition by x, model, dim order by c desc, y) as k from near where c >= {})
"""
_FIVE = "select x as node_id, model, dim, y as other_id, round(c, 6) as cosine, k::int as rank from ranked where k <= 5"
SQL = {
    "p2_found": _NEAR.format("true", 0.9) + "select distinct least(x, y) as node_a, greatest(x, y) as node_b from ranked where k <= 5",
    # the index is exact where a group has no more cells than a query visits, as in tables of this size
    "p2_all": _NEAR.format("true", -2) + _FIVE,
    "p2_knn": _NEAR.format("a.node_id % 50 = 0", -2) + _FIVE,
    "p2_recall": _NEAR.format("a.node_id % 50 = 0", -2) + "select model, dim, count(*) as n_wanted, true as enough from ranked where k <= 5 group by all",
}
