"""Long exact spans shared between records, by sliding runs of sentences.

Punctuation gives no promise: code, tables and scripts without full stops may have no whole
sentence in 200 characters. So a sentence here is a piece between two boundaries that the
text itself sets: a boundary stands where a hash of the next ``GRAM`` characters is the least
within some window of ``REACH`` positions. It depends on nothing further away, so equal
passages are cut alike wherever they stand, and no sentence is longer than ``REACH``.

1. From every sentence, a run of consecutive sentences is hashed. Its end is chosen by the
   same rule within a reach that leaves room for the way to the first boundary, so any
   passage of the minimum length holds at least one whole run that is hashed in every text
   with that passage.
2. Runs are joined globally by hash; those met in one text only drop out. Equal texts (by
   SHA-256) count as one text.
3. For what is left, the text around each run is compared, character by character, which
   gives the exact common passages. Runs met in many texts are not compared pair by pair:
   equal surroundings (bodies) become one, bodies are cut into all passages of the minimum
   length, these are grouped by hash, and each is compared with one passage of its group.

A hash thus only proposes; what is reported was compared. Jobs run while SharedSpans is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.operators.blocks import chunk_pairs, pairs_of_arrays
from strataline.operators.references import salted_join
from strataline.session import materialize, table

MIN_CHARS = 200
GRAM = 8
REACH = 64
#: Characters handled at once; a longer text is taken in overlapping stretches.
STRETCH = 1_000_000
#: A run met in more texts than this is resolved by grouping instead of by pairs.
FEW = 64
#: Stands for the number of texts of a run that repeats itself.
MANY = 1 << 40
#: Members of a group of equal passages or texts in one chunk.
CHUNK = 500

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _slide(x: np.ndarray, window: int, pick) -> np.ndarray:
    """pick over each window of consecutive entries; shorter by window - 1."""
    have = 1
    while have * 2 <= window:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (window - have)], x[window - have :]) if have < window else x


class Hasher:
    """Polynomial hashes of any passage of one stretch of text."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, chars: np.ndarray):
        n = len(chars) + 1
        cls = type(self)
        if len(cls._powers) < n:
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                grown = np.full(max(n, 1 << 16), base, np.uint64)
                grown[0] = 1
                setattr(cls, name, np.multiply.accumulate(grown))
        self.mixed = _mixed(chars.astype(np.uint64) + _BASE)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.mixed * cls._inverses[: n - 1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * type(self)._powers[start] + (end - start).astype(np.uint64))


_PLACE = np.uint64((1 << 21) - 1)


def boundaries(h: Hasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of sentences within n characters; for each window of REACH places, the last least one.

    Places are ordered by the hash of the characters that follow them; of equals the last is less.
    """
    if n < GRAM + REACH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(n - GRAM + 1)
    order = h.of(at, at + GRAM) & ~_PLACE | (_PLACE - at.astype(np.uint64))
    least = (_PLACE - (_slide(order, REACH, np.minimum) & _PLACE)).astype(np.int64)
    return np.unique(least), least


def runs_of(chars: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of the run of sentences that begins at each sentence, and whether it repeats itself.

    The run ends at the boundary that is the least within the last window of its reach, so that
    start and end depend on nothing outside of start + reach.
    """
    reach = min_chars - (REACH + GRAM - 1)  # what is left after the way to the first boundary
    parts = []
    margin = reach + REACH + GRAM
    for begin in range(0, max(len(chars), 1), STRETCH):
        lo, hi = max(0, begin - margin), min(len(chars), begin + STRETCH + margin)
        h = Hasher(chars[lo:hi])
        cut, least = boundaries(h, hi - lo)
        window = cut + reach - GRAM - REACH + 1
        ok = (window < len(least)) & (cut + lo >= begin) & (cut + lo < begin + STRETCH)
        start, end = cut[ok], least[window[ok]]
        if not len(start):
            continue
        parts.append((h.of(start, end), start + lo, end - start))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    hashes, starts, lengths = (np.concatenate(x) for x in zip(*parts))
    # in a passage that repeats itself every few characters, equal runs overlap: keep the first, the last and one in REACH.
    # How such passages lie against each other is then left to the grouping of all their parts.
    loops = np.zeros(len(starts), bool)
    if len(starts) > 1:
        same = (hashes[1:] == hashes[:-1]) & (starts[1:] - starts[:-1] <= REACH)
        head = np.concatenate([[True], ~same])
        tail = np.concatenate([~same, [True]])
        origin = np.maximum.accumulate(np.where(head, np.arange(len(starts)), 0))
        step = (starts - starts[origin]) // REACH
        keep = head | tail | np.concatenate([[True], step[1:] != step[:-1]])
        loops = ~(head & tail)[keep]
        hashes, starts, lengths = hashes[keep], starts[keep], lengths[keep]
    return hashes, starts, lengths, loops


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _emit_runs(min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            cls, texts = b.column(0).to_numpy(), b.column(1)
            held: list[tuple] = []
            rows = 0
            for i in range(b.num_rows):
                if cls[i] in seen:  # an equal text in the same batch
                    continue
                seen.add(cls[i])
                hashes, starts, lengths, loops = runs_of(_chars(texts[i].as_py()), min_chars)
                held.append((np.full(len(starts), cls[i]), hashes.view(np.int64), starts.astype(np.int32), lengths.astype(np.int32), loops))
                rows += len(starts)
                if rows > 200_000 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["cls", "run", "pos", "len", "loops"])
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["cls", "run", "pos", "len", "loops"])

    return work


def _around(min_chars: int):
    """The text around each shared run: as much on either side as can matter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("run", "cls", "pos", "mid", "body", "n")}
            size = 0
            for cls, runs, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                for r in runs:
                    lo, hi = max(0, r["pos"] + r["len"] - min_chars), r["pos"] + min_chars
                    for c, v in zip(out, (r["run"], cls, lo, r["pos"] - lo, text[lo:hi], r["n"])):
                        out[c].append(v)
                    size += hi - lo
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pydict(out, schema=_AROUND)
                    out, size = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=_AROUND)

    return work


_AROUND = pa.schema([("run", pa.int64()), ("cls", pa.int64()), ("pos", pa.int32()), ("mid", pa.int32()), ("body", pa.string()), ("n", pa.int64())])
_PAIRS = "a long, a_lo int, a_hi int, b long, b_lo int, b_hi int"


def _alike(x: str, y: str) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _compare(min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("a_lo", pa.int32()), ("a_hi", pa.int32()), ("b", pa.int64()), ("b_lo", pa.int32()), ("b_hi", pa.int32())])
        for b in batches:
            found = []
            for members in b.column(0).to_pylist():
                cut = [(m["cls"], m["pos"] + m["mid"], m["body"][: m["mid"]][::-1], m["body"][m["mid"] :]) for m in members]
                for i, (a, at_a, back_a, on_a) in enumerate(cut):
                    for c, at_c, back_c, on_c in cut[i + 1 :]:
                        if a == c:
                            continue
                        back, on = _alike(back_a, back_c), _alike(on_a, on_c)
                        if back + on >= min_chars:
                            one, two = (a, at_a - back, at_a + on), (c, at_c - back, at_c + on)
                            found.append((*min(one, two), *max(one, two)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*set(found)), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return work


def _passages(min_chars: int):
    """Every passage of the minimum length in a body, as a hash, with its place and the body's least and greatest text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bid, lo, hi, body in zip(*(b.column(c).to_pylist() for c in ("bid", "lo", "hi", "body"))):
                chars = _chars(body)
                at = np.arange(max(0, len(chars) - min_chars + 1))
                same = np.ones(len(at), np.int64)
                out.append((same * bid, same * lo, same * hi, Hasher(chars).of(at, at + min_chars).view(np.int64), at.astype(np.int32)))
            for k in range(0, len(out), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out[k : k + 2_000])], names=["bid", "lo", "hi", "passage", "off"])

    return work


_TOLD = pa.schema([("bid", pa.int64()), ("passage", pa.int64()), ("off", pa.int32()), ("other", pa.string())])


def _told_apart(min_chars: int):
    """Passages of a body as they are, with ``other``: null if they equal the passage that stands for their group, else their text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in _TOLD.names}
            for bid, body, model, places in zip(*(b.column(c).to_pylist() for c in ("bid", "body", "model", "places"))):
                for p in places:
                    text = body[p["off"] : p["off"] + min_chars]
                    for c, v in zip(out, (bid, p["passage"], p["off"], None if model.startswith(text, p["at"]) else text)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_TOLD)

    return work


class SharedSpans:
    """Shared passages of a corpus: classes of equal texts, linked passages, and what follows from them.

    Texts are taken as stored, by code points. Null, empty and short texts share nothing.
    Repeated rows of a key with equal text count once. Extra columns are not read. An empty
    table gives empty results.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS):
        if min_chars < 2 * (REACH + GRAM):
            raise ValueError(f"min_chars must be at least {2 * (REACH + GRAM)}")
        self.key, self.min_chars = key, min_chars
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
        long = self.docs.filter(F.length("text") >= min_chars)
        seed = 0
        while True:  # a class is known by a short hash; another one is taken if two texts of different SHA-256 have the same
            coded = long.select("doc", F.xxhash64("text", F.lit(seed)).alias("cls"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
            coded = materialize(coded.distinct(), "members")
            if coded.groupBy("cls").agg((F.min("sha") != F.max("sha")).alias("clash")).filter("clash").isEmpty():
                break
            seed += 1
        self.members = coded.drop("sha")
        long = long.withColumn("cls", F.xxhash64("text", F.lit(seed)))
        self.firsts = materialize(self.members.groupBy("cls").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_copies")), "firsts")

        runs = long.select("cls", "text").mapInArrow(_emit_runs(min_chars), "cls long, run long, pos int, len int, loops boolean")
        runs = materialize(runs, "runs")
        # partial sums come before the shuffle, and only runs met in several texts are joined back, hot ones dealt out
        met = runs.groupBy("run").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n_refs"), F.max("loops").alias("any_loops"))
        met = met.filter("lo <> hi").select("run", F.when(F.col("any_loops"), F.lit(MANY)).otherwise(F.col("n_refs")).alias("n"), "n_refs")
        shared = salted_join(runs.drop("loops"), met, ["run"], "cls")
        shared = materialize(shared.select("run", "cls", "pos", "len", "n").distinct(), "shared")

        wanted = shared.groupBy("cls").agg(F.collect_list(F.struct("run", "pos", "len", "n")).alias("runs")).join(self.firsts, "cls")
        # a key may have several texts
        texts = wanted.join(self.docs, "doc").filter(F.xxhash64("text", F.lit(seed)) == F.col("cls")).select("cls", "runs", "text")
        schema = "run long, cls long, pos int, mid int, body string, n long"
        around = materialize(texts.mapInArrow(_around(min_chars), schema), "around")

        few = around.filter(F.col("n") <= FEW).groupBy("run").agg(F.collect_list(F.struct("cls", "pos", "mid", "body")).alias("members"))
        linked = few.select("members").mapInArrow(_compare(min_chars), _PAIRS)
        self.linked = materialize(linked.distinct(), "linked")
        self._group(around.filter(F.col("n") > FEW).select("cls", "pos", "body").distinct())

    def _group(self, hot: DataFrame) -> None:
        """bodies: bid, body, cls (a row for each text with the body, at pos); grouped: bid, off, passage, other of passages met in several texts."""
        hot = materialize(hot, "hot")
        each = hot.groupBy("body").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n_refs"))
        each = materialize(each.withColumn("bid", F.monotonically_increasing_id()), "bodies")
        self.bodies = materialize(salted_join(hot, each.select("body", "bid", "n_refs"), ["body"], "cls").select("bid", "cls", "pos"), "held")
        cut = each.select("bid", "lo", "hi", "body").mapInArrow(_passages(self.min_chars), "bid long, lo long, hi long, passage long, off int")
        cut = materialize(cut, "passages")
        groups = cut.groupBy("passage").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("bid", "off")).alias("model"), F.count(F.lit(1)).alias("n_refs")).filter("lo <> hi")
        met = salted_join(cut.select("passage", "bid", "off"), groups.select("passage", "model", "n_refs"), ["passage"], "bid")
        pairs = met.groupBy("bid", F.col("model.bid").alias("mid")).agg(F.collect_list(F.struct("off", "passage", F.col("model.off").alias("at"))).alias("places"))
        pairs = materialize(pairs, "met")
        models = pairs.groupBy("mid").agg(F.count(F.lit(1)).alias("n_refs")).join(each.select(F.col("bid").alias("mid"), F.col("body").alias("model")), "mid")
        texts = salted_join(pairs, models, ["mid"], "bid").join(each.select("bid", "body", "lo", "hi"), "bid")
        told = texts.select("bid", "body", "model", "places").mapInArrow(_told_apart(self.min_chars), "bid long, passage long, off int, other string")
        # without a clash of hashes ``other`` is null throughout, and the groups are as they were
        self.grouped = materialize(told, "grouped")
        if not self.grouped.filter("other is not null").isEmpty():
            ends = self.grouped.join(each.select("bid", "lo", "hi"), "bid")
            w = Window.partitionBy("passage", "other")
            ends = ends.withColumn("lo", F.min("lo").over(w)).withColumn("hi", F.max("hi").over(w)).filter("lo <> hi")
            self.grouped = materialize(ends.drop("lo", "hi"), "grouped")

    def class_pairs(self) -> DataFrame:
        """a, b: classes of equal texts that share a passage, a < b."""
        direct = self.linked.select("a", "b")
        # groups of passages with one set of bodies need be paired once: they are known by a hash of the set, and only the least of them is kept
        sets = self.grouped.select("passage", "other", "bid").distinct()
        sign = sets.groupBy("passage", "other").agg(F.sum(F.xxhash64("bid").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("bid", F.lit(7))).alias("s2"), F.count(F.lit(1)).alias("n_refs"))
        one = sign.groupBy("s1", "s2", "n_refs").agg(F.min(F.struct("passage", "other")).alias("p")).select("p.*", "n_refs").withColumn("set", F.monotonically_increasing_id())
        one = materialize(one, "sets").select("passage", F.coalesce("other", F.lit("")).alias("other"), "n_refs", "set")
        held = salted_join(sets.withColumn("other", F.coalesce("other", F.lit(""))), one, ["passage", "other"], "bid").select("set", "bid")
        use = materialize(self.bodies.select("bid", "cls").distinct(), "texts")
        members = salted_join(use, held.join(use.groupBy("bid").agg(F.count(F.lit(1)).alias("n_refs")), "bid"), ["bid"], "cls")
        members = materialize(members.select("set", "cls").distinct(), "sets")
        sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
        pairs = pairs_of_arrays(chunk_pairs(members, ["set"], "cls", sizes, CHUNK, F.xxhash64("cls")), [])
        return direct.unionByName(pairs).distinct()

    def pairs(self) -> DataFrame:
        """doc_a, doc_b: every pair of documents that shares a passage, equal texts included."""
        cls = materialize(self.class_pairs(), "pairs")
        # copies and links of a class multiply: each end is joined with the documents of its class, dealt out
        ends = lambda c: cls.groupBy(c).agg(F.count(F.lit(1)).alias("n_refs"))
        side = lambda c, d: self.members.select(F.col("cls").alias(c), F.col("doc").alias(d)).join(ends(c), c)
        apart = salted_join(salted_join(cls, side("a", "x"), ["a"], "b"), side("b", "y"), ["b"], "x").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        copies = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
        equal = pairs_of_arrays(chunk_pairs(self.members, ["cls"], "doc", copies, CHUNK, F.xxhash64("doc")), [], "doc_a", "doc_b")
        return apart.unionByName(equal)

    def classes(self) -> DataFrame:
        """doc, class (the least document with the same text), n_copies, n_links (other texts it shares a passage with)."""
        firsts = self.firsts.select("cls", F.col("doc").alias("class"), "n_copies")
        pairs = self.class_pairs()
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        links = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
        per_class = firsts.join(links, "cls", "left")
        per_class = per_class.withColumn("n_refs", F.col("n_copies"))
        return salted_join(self.members, per_class, ["cls"], "doc").select(F.col("doc").alias(self.key), "class", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def _stretches(self, runs: DataFrame, by: str) -> DataFrame:
        """by, lo, hi: the runs (by, lo, hi) joined where they touch or overlap."""
        w = Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
        begins = runs.distinct().withColumn("before", F.max("hi").over(w))
        begins = begins.withColumn("first", F.when(F.col("before").isNull() | (F.col("lo") > F.col("before")), F.lit(1)).otherwise(F.lit(0)))
        part = F.sum("first").over(Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0))
        return begins.withColumn("part", part).groupBy(by, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")

    def _covered(self, later: bool = False) -> DataFrame:
        """cls, lo, hi: disjoint stretches of a text that stand in another, different text, too.

        ``later``: in one whose first document is less than this text's first.
        """
        linked, groups = self.linked, self.grouped
        sides = [(x, y, F.lit(True)) for x, y in (("a", "b"), ("b", "a"))]
        if later:
            order = lambda c: self.firsts.select(F.col("cls").alias(c), F.col("doc").alias(f"{c}_doc"))
            linked = materialize(linked.join(order("a"), "a").join(order("b"), "b"), "ordered")
            sides = [(x, y, F.col(f"{y}_doc") < F.col(f"{x}_doc")) for x, y, _ in sides]
        parts = [linked.filter(keep).select(F.col(x).alias("cls"), F.col(f"{x}_lo").alias("lo"), F.col(f"{x}_hi").alias("hi")) for x, y, keep in sides]
        # the passages of a body are joined to stretches before they are put into each of its texts
        runs = groups.select("bid", F.col("off").alias("lo"), (F.col("off") + self.min_chars).alias("hi"))
        held = self.bodies
        if later:
            # a body's passages come first in the text with the least first document; elsewhere they are later ones
            held = held.join(self.firsts.select("cls", "doc"), "cls")
            least = held.groupBy("bid").agg(F.min("doc").alias("least"))
            firsts = groups.join(least, "bid").groupBy("passage", F.coalesce("other", F.lit("")).alias("other")).agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n_refs"))
            placed = salted_join(groups.withColumn("other", F.coalesce("other", F.lit(""))), firsts, ["passage", "other"], "bid")
            runs = placed.select(F.concat_ws(" ", F.col("bid"), F.col("first")).alias("key"), "bid", "first", F.col("off").alias("lo"), (F.col("off") + self.min_chars).alias("hi"))
            names = runs.select("key", "bid", "first").distinct()
            joined = self._stretches(runs.select("key", "lo", "hi"), "key").join(names, "key").drop("key")
        else:
            joined = self._stretches(runs, "bid")
        joined = joined.join(held.groupBy("bid").agg(F.count(F.lit(1)).alias("n_refs")), "bid")
        put = salted_join(held, joined, ["bid"], "cls")
        put = put.filter(F.col("doc") > F.col("first")) if later else put
        parts.append(put.select("cls", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi")))
        return self._stretches(reduce(DataFrame.unionByName, parts), "cls")

    def report(self) -> DataFrame:
        """For every document: its length, the characters shared with other documents, their share and the runs."""
        spans = self._covered().groupBy("cls").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("part"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        known = self.firsts.select("cls", "n_copies").join(spans, "cls", "left").withColumn("n_refs", F.col("n_copies"))
        known = salted_join(self.members, known, ["cls"], "doc").drop("cls")
        n = F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))
        sized = self.docs.select("doc", n.alias("n_chars")).join(known, "doc", "left")
        whole = F.coalesce(F.col("n_copies") > 1, F.lit(False))
        chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0).cast("long")))
        spans_text = F.when(whole, F.concat(F.lit("0-"), F.col("n_chars").cast("string"))).otherwise(
            F.concat_ws(",", F.transform(F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")), lambda s: F.concat(s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string"))))
        )
        return sized.select(
            F.col("doc").alias(self.key), "n_chars", chars.alias("shared_chars"),
            F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared"), spans_text.alias("spans"),
        )


def remove_repeated(docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, n_chars, kept): texts without the passages of ``min_chars`` and more that an earlier record has already shown.

    Records are ordered by their key. Every place of a repeated span but that in the least record
    that has it is removed, to the character; a copy of a whole text keeps nothing. What a text
    repeats only within itself stays. Null and shorter texts stay as they are. Keys are unique and not null.
    """
    spans = SharedSpans(docs, key, text, min_chars)
    gone = spans._covered(later=True).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("gone"))
    known = spans.firsts.select("cls", F.col("doc").alias("first"), F.col("n_copies").alias("n_refs")).join(gone, "cls", "left")
    known = salted_join(spans.members, known, ["cls"], "doc")
    cuts = known.select("doc", F.when(F.col("doc") == F.col("first"), F.col("gone")).alias("gone"), (F.col("doc") != F.col("first")).alias("copy"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, gaps, copy in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                at, parts = 0, []
                for s in gaps or ():
                    parts.append(t[at : s["lo"]])
                    at = s["hi"]
                kept.append("" if copy else t if not gaps else "".join(parts) + t[at:])
            sizes = pa.array([None if t is None else len(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(kept, pa.string())], names=[key, "n_chars", "kept"])

    kind = spans.docs.schema[0].dataType.simpleString()
    return spans.docs.join(cuts, "doc", "left").select("doc", "text", "gone", "copy").mapInArrow(cut, f"`{key}` {kind}, n_chars long, kept string")


def _spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return SharedSpans(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).pairs()


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in another one, and where."""
    return _spans(spark, sf_dir).report()


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of equal texts and the number of other texts it is linked to."""
    return _spans(spark, sf_dir).classes()


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document that are left when spans are removed that an earlier document has shown."""
    kept = remove_repeated(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", "n_chars", F.length("kept").cast("long").alias("kept_chars"))


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared, "p8_classes": p8_classes, "p8_kept": p8_kept}
# brute force over every passage of 200 characters: fit for corpora of some million characters
_PASSAGES = """
with p as materialized (
  select doc_id, i, md5(substr(text, i, 200)) as h
  from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)
)
"""
SQL = {
    "p8_found": _PASSAGES
    + """, d as (select distinct doc_id, h from p where h in (select h from p group by h having min(doc_id) <> max(doc_id)))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id""",
    "p8_classes": _PASSAGES
    + """, d as (select distinct doc_id, h from p where h in (select h from p group by h having min(doc_id) <> max(doc_id))),
c as (select doc_id, min(doc_id) over (partition by text) as class, count(*) over (partition by text) as n_copies from documents where length(text) >= 200),
linked as (select distinct a.doc_id as x, b.doc_id as y from d a join d b on a.h = b.h and a.doc_id <> b.doc_id),
l as (select cx.class, count(distinct cy.class) as n from linked join c cx on cx.doc_id = x join c cy on cy.doc_id = y where cx.class <> cy.class group by cx.class)
select c.doc_id, c.class, c.n_copies, coalesce(l.n, 0) as n_links from c left join l on l.class = c.class""",
    "p8_shared": _PASSAGES
    + """, s as (select doc_id, i from p where h in (select h from p group by h having min(doc_id) <> max(doc_id))),
starts as (select *, case when i - lag(i) over w <= 200 then 0 else 1 end as fresh from s window w as (partition by doc_id order by i)),
parts as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as part from starts),
runs as (select doc_id, min(i) - 1 as lo, max(i) + 199 as hi from parts group by doc_id, part),
per_doc as (select doc_id, sum(hi - lo)::bigint as n, string_agg(lo || '-' || hi, ',' order by lo) as spans from runs group by doc_id)
select d.doc_id, coalesce(length(text), 0)::bigint as n_chars, coalesce(n, 0) as shared_chars,
       case when length(text) > 0 then coalesce(n, 0) / length(text)::double else 0.0::double end as shared, coalesce(spans, '') as spans
from documents d left join per_doc using (doc_id)""",
    "p8_kept": _PASSAGES
    + """, f as (select h, min(doc_id) as first from p group by h),
s as (select doc_id, i from p join f using (h) where f.first < p.doc_id),
starts as (select *, case when i - lag(i) over w <= 200 then 0 else 1 end as fresh from s window w as (partition by doc_id order by i)),
parts as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as part from starts),
gone as (select doc_id, sum(n)::bigint as n from (select doc_id, max(i) - min(i) + 200 as n from parts group by doc_id, part) group by doc_id)
select d.doc_id, length(text)::bigint as n_chars, (length(text) - coalesce(n, 0))::bigint as kept_chars from documents d left join gone using (doc_id)""",
}
