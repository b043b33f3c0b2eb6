"""Filling fixed-capacity containers with items.

Sizes are gathered into a histogram, so all planning is over lengths, not items:

1. Patterns of few lengths that fill a container are enumerated over a coarsened histogram
   (two or three lengths, or one length repeated and one to complete it).
2. Non-negative least squares fits the patterns' repeat counts to the histogram.
3. The counts are rounded down to what the exact histogram still holds.
4. The residual, and the room left in pattern containers, is packed by best fit over the
   exact histogram, longest first.

The plan is a list of runs "items a..b of length L go to containers c.. , m in each". Items are
numbered within their length by two-step prefix sums, and each finds its run by a join. Only
the histogram below the capacity and the plan reach the driver; both are bounded by the
capacity, not by the number of items.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.llm.tokens import token_counts
from strataline.session import materialize, table, width

#: Steps that a capacity is coarsened to when patterns are enumerated.
UNITS = 256
#: Rounds of the least-squares fit.
ROUNDS = 400
#: Items numbered together in one task at most; a length held by more is numbered in several.
ITEMS_PER_BLOCK = 200_000
#: Runs of a plan up to which it is sent to all tasks; a longer one is joined.
SENT_RUNS = 200_000
#: Containers are described to the driver by kind; more kinds than this are refused.
MOST_KINDS = 1_000


def patterns(units: int, has: np.ndarray) -> np.ndarray:
    """Lengths (in units, 0 for none) and their multiplicity in patterns that come out at ``units``.

    Columns: three lengths, then three multiplicities. Only lengths with has[length] are used.
    """
    rows = [(units, 0, 0, 1, 0, 0)] if has[units] else []
    lengths = np.flatnonzero(has[1:units]) + 1
    inside = has.copy()
    for a in lengths:
        rest = units - a
        b = lengths[(lengths >= a) & (lengths <= rest // 2)]
        c = rest - b
        ok = inside[c]
        rows += [(a, x, y, 1, 1, 1) for x, y in zip(b[ok], c[ok])]
        if rest >= a and inside[rest]:
            rows.append((a, rest, 0, 1, 1, 0))
        for k in range(max(3, units // a - 3), units // a + 1):  # one length repeated, one to complete it
            left = units - k * a
            if left == 0:
                rows.append((a, 0, 0, k, 0, 0))
            elif left > 0 and left != a and inside[left]:
                rows.append((a, left, 0, k, 1, 0))
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def fit(pats: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises the weighted || A x - hist ||, by accelerated projected gradients.

    A row (a length) is weighted by its length over the square root of its count, so that the
    room is fitted rather than the number of items.
    """
    if not len(pats) or not hist.any():
        return np.zeros(len(pats))
    size = len(hist)
    weight = np.where(hist > 0, np.arange(size) / np.sqrt(np.maximum(hist, 1)), 0.0)
    at, times = pats[:, :3], pats[:, 3:].astype(float)
    times = times * weight[at]
    goal = hist * weight
    scale = np.sqrt(np.maximum((times**2).sum(1), 1e-12))  # columns of norm one
    times = times / scale[:, None]
    ahead = lambda x: np.bincount(at.ravel(), (times * x[:, None]).ravel(), minlength=size)
    back = lambda r: (times * r[at]).sum(1)
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(ahead(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / max(top * 1.05, 1e-12)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(ahead(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / scale


@dataclass
class Plan:
    """Runs of items: length, first and last + 1 within the length, first container, items per container."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0


def pack(hist: np.ndarray, capacity: int, units: int = UNITS) -> Plan:
    """Plan for hist[length] items of each length from 1 to capacity."""
    plan = Plan()
    left = hist.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, np.int64)
    room: dict[int, list[list[int]]] = {}  # free space -> [first container, how many]
    spaces: list[int] = []  # of room, in order

    def use(length: int, n: int, base: int, each: int) -> None:
        plan.runs.append((length, int(taken[length]), int(taken[length] + n), base, each))
        taken[length] += n
        left[length] -= n

    def keep(space: int, base: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append([base, n])

    # full containers of one item need no pattern
    if left[capacity]:
        n = int(left[capacity])
        use(capacity, n, plan.containers, 1)
        plan.containers += n
    grain = -(-capacity // units)
    top = capacity // grain  # the largest pattern in whole grains: its items, rounded up, fit
    unit_of = -(-np.arange(capacity + 1) // grain)
    coarse = np.bincount(unit_of, left, minlength=top + 2)[: top + 1]
    pats = patterns(top, coarse > 0)
    repeats = np.floor(fit(pats, coarse) + 0.5).astype(np.int64)
    by_unit: list[list[int]] = [[] for _ in range(top + 2)]
    for length in range(1, capacity):
        if left[length]:
            by_unit[unit_of[length]].append(length)  # popped from the end: the longest first
    for p in np.argsort(-repeats, kind="stable"):
        n = int(repeats[p])
        if n <= 0:
            break
        needs = [(int(u), int(m)) for u, m in zip(pats[p, :3], pats[p, 3:]) if m]
        while n > 0:
            # a piece of the repeats in which each slot is filled from one exact length
            slots, free, room_for = [], capacity, n
            wanted: dict[int, int] = {}
            for u, m in needs:
                while by_unit[u] and left[by_unit[u][-1]] - wanted.get(by_unit[u][-1], 0) < m:
                    if left[by_unit[u][-1]] == 0:
                        by_unit[u].pop()
                    else:
                        break
                at = next((x for x in reversed(by_unit[u]) if left[x] - wanted.get(x, 0) >= m), None)
                if at is None:
                    room_for = 0
                    break
                wanted[at] = wanted.get(at, 0) + m
                slots.append((at, m))
                free -= at * m
            if not room_for:
                break
            room_for = min(room_for, *(int(left[x] // w) for x, w in wanted.items()))
            for at, m in slots:
                use(at, room_for * m, plan.containers, m)
            keep(free, plan.containers, room_for)
            plan.containers += room_for
            n -= room_for
    for length in range(capacity, 0, -1):
        while left[length]:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                n = int(left[length])
                whole, rest = divmod(n, each)
                if whole:
                    use(length, whole * each, plan.containers, each)
                    keep(capacity - each * length, plan.containers, whole)
                    plan.containers += whole
                if rest:
                    use(length, rest, plan.containers, rest)
                    keep(capacity - rest * length, plan.containers, 1)
                    plan.containers += 1
                break
            space = spaces[i]
            base, n = room[space][-1]
            each = min(space // length, int(left[length]))
            some = min(n, int(left[length]) // each)
            use(length, some * each, base, each)
            if some == n:
                room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
            else:
                room[space][-1] = [base + some, n - some]
            keep(space - each * length, base, some)
    return plan


def _numbered(sizes: DataFrame, n_items: int) -> DataFrame:
    """sizes with ``rank``, from 0 within n_tokens: a count by block, then a place in the block."""
    blocks = max(width(sizes.sparkSession), -(-n_items // ITEMS_PER_BLOCK))
    dealt = sizes.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    counts = dealt.groupBy("n_tokens", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("n_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("n_tokens", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("n_tokens", "block").orderBy("item")) - 1
    return dealt.withColumn("place", place).join(counts, ["n_tokens", "block"]).select("item", "n_tokens", (F.col("before") + F.col("place")).alias("rank"))


def pack_corpus(sizes: DataFrame, containers: DataFrame, item: str, kind: str = "container_kind", capacity: str = "capacity") -> DataFrame:
    """container_kind, container_no, item, piece_no, start_token, n_tokens: every item in a container of every kind.

    sizes: the item and ``n_tokens``. An item above the capacity is cut into pieces of the
    capacity, each alone in its container, and a remainder that is packed like an item; no
    other item is cut. Items of size zero (empty and null texts, null sizes) go to container 0
    with nothing in it. Containers of a kind are numbered from 0. Repeated item ids are items
    of their own. Kinds with a null or non-positive capacity hold nothing and are left out;
    repeated kinds count once, with the larger capacity. Empty tables give an empty result.
    Other columns are not read.
    """
    spark = sizes.sparkSession
    one = sizes.select(F.col(item).alias("item"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    one = materialize(one, "sizes")
    n_items = one.count()
    known = containers.filter(F.col(capacity) > 0).groupBy(F.col(kind).alias("kind")).agg(F.max(capacity).cast("long").alias("cap"))
    kinds = known.limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    schema = f"container_kind {dict(containers.dtypes)[kind]}, container_no long, `{item}` {dict(sizes.dtypes)[item]}, piece_no int, start_token long, n_tokens long"
    if not kinds or not n_items:
        return spark.createDataFrame([], schema)
    kind_type = dict(containers.dtypes)[kind]
    caps = F.array(*(F.struct(F.lit(r["kind"]).cast(kind_type).alias("kind"), F.lit(r["cap"]).cast("long").alias("cap")) for r in kinds))

    # one row for each kind and distinct length; from here to the plan, rows follow the lengths
    lengths = one.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    each = lengths.select("n_tokens", "n", F.explode(caps).alias("c")).select("n_tokens", "n", "c.*").withColumn("full", F.floor(F.col("n_tokens") / F.col("cap"))).withColumn("rest", F.col("n_tokens") % F.col("cap"))
    by_rest = Window.partitionBy("kind", "rest").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    by_kind = Window.partitionBy("kind").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("rest_from", F.coalesce(F.sum("n").over(by_rest), F.lit(0)))
    # of lengths below the capacity nothing is cut, so only the few above are summed in order
    large = each.filter("full > 0").withColumn("full_from", F.coalesce(F.sum(F.col("n") * F.col("full")).over(by_kind), F.lit(0)))
    each = materialize(large.unionByName(each.filter("full = 0").withColumn("full_from", F.lit(0).cast("long"))), "lengths")

    found = each.filter("rest > 0").groupBy("kind", "rest").agg(F.sum("n").alias("n")).collect()  # at most the sum of the capacities
    runs, packed = [], []
    for r in kinds:
        hist = np.zeros(r["cap"] + 1, np.int64)
        for x in found:
            if x["kind"] == r["kind"]:
                hist[x["rest"]] = x["n"]
        plan = pack(hist, r["cap"])
        packed.append((r["kind"], plan.containers))
        runs += [(r["kind"], *map(int, x)) for x in plan.runs]
    runs_df = spark.createDataFrame(runs, f"kind {kind_type}, rest long, run_from long, run_to long, base long, per long")
    packed_df = spark.createDataFrame(packed, f"kind {kind_type}, packed long")

    items = _numbered(one, n_items).join(each.select("n_tokens", "kind", "cap", "full", "rest", "rest_from", "full_from"), "n_tokens")
    items = materialize(items.join(F.broadcast(packed_df), items["kind"].eqNullSafe(packed_df["kind"])).drop(packed_df["kind"]), "items")
    whole = items.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    whole = whole.select(
        "kind", (F.col("packed") + F.col("full_from") + F.col("rank") * F.col("full") + F.col("piece")).alias("container_no"), "item",
        F.col("piece").cast("int").alias("piece_no"), (F.col("piece") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"),
    )
    runs_df = F.broadcast(runs_df) if len(runs) <= SENT_RUNS else runs_df
    slot = F.col("rest_from") + F.col("rank")
    rests = items.filter("rest > 0").withColumn("slot", slot).alias("i").join(
        runs_df.alias("r"),
        F.expr("i.kind <=> r.kind and i.rest = r.rest and i.slot >= r.run_from and i.slot < r.run_to"),
    )
    rests = rests.select(
        F.col("i.kind").alias("kind"), (F.col("r.base") + F.floor((F.col("i.slot") - F.col("r.run_from")) / F.col("r.per"))).cast("long").alias("container_no"), "i.item",
        F.col("i.full").cast("int").alias("piece_no"), (F.col("i.full") * F.col("i.cap")).alias("start_token"), F.col("i.rest").alias("n_tokens"),
    )
    none = items.filter("n_tokens = 0").select("kind", F.lit(0).cast("long").alias("container_no"), "item", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"))
    return whole.unionByName(rests).unionByName(none).withColumnRenamed("kind", "container_kind").withColumnRenamed("item", item)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return pack_corpus(sizes, table(spark, sf_dir, "containers"), "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind: containers used, tokens in them and the share of the room that is filled."""
    packed = p7_pack(spark, sf_dir).groupBy("container_kind").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))
    caps = table(spark, sf_dir, "containers")
    return packed.join(caps, "container_kind").withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind: documents packed, and whether all tokens are there, none is over the capacity, none that fits is cut, and the room left is small.

    Room is judged against the least number of containers that any packing needs: pieces of the
    whole capacity, and the rest of the tokens without any room left; 1 % more is allowed, and one container.
    """
    sizes = materialize(token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "counts")
    packed = materialize(pack_corpus(sizes, table(spark, sf_dir, "containers"), "doc_id"), "packed")
    caps = table(spark, sf_dir, "containers", "container_kind", "capacity").filter("capacity > 0")
    filled = packed.groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("n"), F.min("n_tokens").alias("least")).join(caps, "container_kind")
    boxes = filled.filter("n > 0").groupBy("container_kind").agg(F.count(F.lit(1)).alias("boxes"), F.max(F.col("n") - F.col("capacity")).alias("over"))
    # each document: its pieces follow one another without a gap and end where it ends
    piece = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    whole = piece.join(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size")), "doc_id").join(caps, "container_kind")
    fair = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size"))
    uncut = F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    docs = whole.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(fair).alias("whole"), F.bool_and(uncut).alias("uncut"), F.sum("size").alias("tokens"), F.max("capacity").alias("capacity"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return docs.join(boxes, "container_kind").select("container_kind", "n_docs", "whole", "uncut", (F.col("over") <= 0).alias("within"), (F.col("boxes") <= least * 1.01 + 1).alias("tight"))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill, "p7_check": p7_check}
SQL = {
    "p7_check": "select container_kind, (select count(*) from documents) as n_docs, true as whole, true as uncut, true as within, true as tight from containers where capacity > 0",
}
