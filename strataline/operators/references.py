"""References to records that do not exist.

A reference is a tuple of columns that ought to name a row of another table. References
are grouped by their null mask, and each mask is matched on its non-null columns only.
The match semantics decide what a mask means:

``simple``   a tuple with any null is satisfied; only full tuples are matched.
``full``     a tuple of nulls is satisfied; one with some nulls is an orphan by itself.
``partial``  a tuple with some nulls must agree with a row in its non-null columns.
``first``    the first non-null column alone decides, each column against its own target.

The references are written once, and all their masks are matched in one pass: the mask is part
of the key, in which columns that it leaves out are blank. Matching works on distinct keys:
references are pre-aggregated per key before any join, so a key that holds a third of all rows
is one row there. Only keys that fail are joined back to the references, and the heavy ones
among them are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.session import materialize

#: A failing key with more references than this is spread over several tasks ...
ROWS_PER_TASK = 500_000
#: ... unless more than so many keys would be: then only those above an even share of the references.
MOST_SALTED = 256

MATCHES = ("simple", "full", "partial", "first")


def salted_join(refs: DataFrame, keys: DataFrame, key: list[str], row_id: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of references with failing keys (``n_refs`` known for each).

    A key with n references is repeated ceil(n / share) times, and its references are dealt
    to the copies by a hash of their row id. The share is at least total / 256, so at most
    256 keys are salted: that list alone is broadcast, whatever the size of the data. A key may
    have several rows if all of them name the same n_refs.
    """
    keys = materialize(keys, "keys")
    total = keys.agg(F.sum("n_refs")).first()[0] or 0
    share = max(rows_per_task, -(-total // MOST_SALTED))
    keys = keys.withColumn("_copies", F.ceil(F.col("n_refs") / F.lit(float(share))).cast("int"))
    salt = F.lit(0)
    if total > share:
        heavy = keys.filter("_copies > 1").select(*key, F.col("_copies").alias("_deal")).distinct()
        refs = refs.join(F.broadcast(heavy), key, "left")
        salt = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_deal")), F.lit(0)).cast("int")
    dealt = refs.withColumn("_salt", salt).drop("_deal")
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return dealt.join(spread, [*key, "_salt"]).drop("_salt", "n_refs")


def _keyed(df: DataFrame, cols: list[str], types: list[str], masks: list[str], extra: list[Column], first: bool, at: int = 0) -> DataFrame:
    """_part, _k..., extra: the keys that rows of a target offer, one for each mask whose columns are set.

    Under ``first`` a target answers for its column alone (``at``), and the key is that column.
    """
    text = [F.col(c).cast(t).cast("string") for c, t in zip(cols, types)]
    if first:
        offered = df.select(F.lit(str(at)).alias("_part"), text[0].alias("_k0"), *extra)
        return offered.filter("_k0 is not null")
    named = df.select(*(c.alias(f"_k{i}") for i, c in enumerate(text)), *extra)
    key = lambda m: F.struct(F.lit(m).alias("_part"), *((F.col(f"_k{i}") if b == "1" else F.lit("")).alias(f"_k{i}") for i, b in enumerate(m)))
    known = lambda m: reduce(lambda a, b: a & b, [F.col(f"_k{i}").isNotNull() for i, b in enumerate(m) if b == "1"])
    rest = named.columns[len(cols) :]
    keys = named.select(F.explode(F.array_compact(F.array(*(F.when(known(m), key(m)) for m in masks)))).alias("_key"), *rest)
    return keys.select("_key.*", *rest)


def orphan_references(
    refs: DataFrame,
    targets: DataFrame | list[DataFrame],
    on: list[tuple[str, str]],
    row_id: str,
    match: str = "simple",
    ref_at: str | None = None,
    target_at: str | None = None,
    removed: DataFrame | list[DataFrame | None] | None = None,
    keep_at: bool = False,
) -> DataFrame:
    """Orphans among composite references: (row_id, mask, state), with ref_at if ``keep_at``.

    ``on`` pairs reference columns with target columns. Under ``first``, targets (and removed)
    are lists, one table for each pair; else one table. ``mask`` has one letter for each
    column, ``1`` where the reference is set. ``state`` is ``missing``, ``deleted`` (missing,
    and the key is in ``removed``, which has the target columns), ``late`` (the target arrived
    after the reference; only with both arrival columns) or ``partial_null`` (``full`` only).

    Nulls: see the module. Empty strings are values like any other. A repeated row of
    ``refs`` (same id, same key) is one reference with its earliest arrival; repeated rows
    of ``targets`` count once. Empty tables: without references the result is empty,
    without targets every matched reference is missing. Other columns of either table,
    whatever their names, are not read. Keys are compared as text in the type of the reference.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    first = match == "first"
    cols, names = [r for r, _ in on], [f"_k{i}" for i in range(len(on))]
    types = [refs.select(c).schema[0].dataType.simpleString() for c in cols]
    timed = ref_at is not None and target_at is not None
    keep = [F.col(row_id).alias("_row"), *(F.col(r).cast("string").alias(n) for r, n in zip(cols, names))]
    one = refs.select(*keep, (F.col(ref_at) if timed or keep_at else F.lit(None).cast("timestamp")).alias("_at"))
    one = one.groupBy("_row", *names).agg(F.min("_at").alias("_at"))
    mask = F.concat(*(F.when(F.col(n).isNull(), F.lit("0")).otherwise(F.lit("1")) for n in names))
    one = materialize(one.withColumn("mask", mask), "references")
    masks = sorted(r[0] for r in one.select("mask").distinct().collect())  # at most 2 to the power of the columns
    looked_up = [m for m in masks if "1" in m and ("0" not in m or match in ("partial", "first"))]
    out = ["_row", "mask", "state", *(["_at"] if keep_at else [])]
    parts = []
    if match == "full":
        parts.append(one.filter(F.col("mask").contains("0") & F.col("mask").contains("1")).withColumn("state", F.lit("partial_null")).select(*out))
    if looked_up:
        some = one.filter(F.col("mask").isin(looked_up))
        key = ["_part", "_k0"] if first else ["_part", *names]
        if first:
            some = some.select("_row", "mask", "_at", (F.locate("1", F.col("mask")) - 1).cast("string").alias("_part"), F.coalesce(*names).alias("_k0"))
        else:
            some = some.select("_row", "mask", "_at", F.col("mask").alias("_part"), *(F.coalesce(n, F.lit("")).alias(n) for n in names))
        came = [(F.col(target_at) if timed else F.lit("1970-01-01").cast("timestamp")).alias("_in")]
        ends = [t for _, t in on]

        def offered(tables, extra):
            if not first:
                return _keyed(tables, ends, types, looked_up, extra, False)
            each = [_keyed(t, [ends[i]], [types[i]], [], extra, True, i) for i, t in enumerate(tables) if t is not None]
            return reduce(DataFrame.unionByName, each)

        goal = offered(targets, came).groupBy(*key).agg(F.min("_in").alias("target_at"))
        seen = some.groupBy(*key).agg(F.count(F.lit(1)).alias("n_refs"), F.min("_at").alias("first_ref"))
        late = (F.col("target_at") > F.col("first_ref")) if timed else F.lit(False)
        bad = seen.join(goal, key, "left").filter(F.col("target_at").isNull() | late).drop("first_ref")
        gone = removed if not isinstance(removed, list) or any(t is not None for t in removed) else None
        if gone is not None:
            bad = bad.join(offered(gone, []).distinct().withColumn("gone", F.lit(True)), key, "left")
        else:
            bad = bad.withColumn("gone", F.lit(None).cast("boolean"))
        hit = salted_join(some, bad, key, "_row")
        hit = hit.filter(F.col("target_at").isNull() | (F.col("target_at") > F.col("_at"))) if timed else hit
        state = F.when(F.col("target_at").isNotNull(), F.lit("late")).when(F.col("gone"), F.lit("deleted")).otherwise(F.lit("missing"))
        parts.append(hit.withColumn("state", state).select(*out))
    found = reduce(DataFrame.unionByName, parts) if parts else one.withColumn("state", F.lit("missing")).select(*out).limit(0)
    found = found.withColumnRenamed("_row", row_id)
    return found.withColumnRenamed("_at", ref_at) if keep_at else found
