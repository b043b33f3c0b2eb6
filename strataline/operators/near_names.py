"""Pairs of names within a small edit distance, without comparing all pairs.

Two strings within d edits share at least one variant with at most d characters deleted.
Each distinct name is joined on its variants; the distance is then computed exactly.

The variants of a name grow with the d-th power of its length, so names longer than ``SHORT``
are cut into d // 2 + 1 pieces. Of two of them within d edits one piece of the one is within one
edit of a part of the other near the same place, and shares a variant of at most one deletion
with it. Variants are joined by their hashes; equal hashes of unequal ones only add comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names up to this length are joined on variants of the whole name.
SHORT = 32
#: Odd, so that it can be divided by modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _variants(s: str, most: int) -> list[str]:
    level = out = {s}
    for _ in range(most):
        level = {v[:i] + v[i + 1 :] for v in level for i in range(len(v))}
        out = out | level
    return sorted(out)


def _shorter(s: str) -> np.ndarray:
    """Hashes of s and of s without one character each."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(c), _BASE, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers, dtype=np.uint64)])
    return np.unique(np.append(sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_BACK), sums[-1]))


def _parts(m: int, n: int, most: int) -> Iterator[tuple[int, int, int]]:
    """piece, start, end: parts of a name of length m that a piece of one of length n may have become."""
    pieces = most // 2 + 1
    for i in range(pieces):
        a, b = n * i // pieces, n * (i + 1) // pieces
        for size in range(b - a - 1, b - a + 2):
            starts = [0] if i == 0 else [m - size] if i == pieces - 1 else range(a - most, a + most + 1)
            for start in starts:
                if 0 <= start and start + size <= m:
                    yield i, start, start + size


def _piece_keys(s: str, most: int, asks: bool) -> list[int]:
    """Keys of the variants of a name's pieces, or (asks) of its parts for every length that the other name may have."""
    m, pieces = len(s), most // 2 + 1
    own = [(m, i, m * i // pieces, m * (i + 1) // pieces) for i in range(pieces)]
    wanted = {(n, *p) for n in range(m - most, m + most + 1) for p in _parts(m, n, most)} if asks else own
    keys = [_shorter(s[a:b]) * np.uint64(_BACK) + np.uint64(n * pieces + i) for n, i, a, b in wanted]
    return np.unique(np.concatenate(keys)).view(np.int64).tolist()


def near_names(left: DataFrame, right: DataFrame, column: str, most: int = 2) -> DataFrame:
    """name, near, distance: names of ``left`` that ``right`` lacks, with the names of ``right`` within ``most`` edits."""

    @F.pandas_udf("array<string>")
    def variants(names: pd.Series) -> pd.Series:
        return names.map(lambda s: _variants(s, most))

    @F.pandas_udf("array<long>")
    def asked(names: pd.Series) -> pd.Series:
        return names.map(lambda s: _piece_keys(s, most, True))

    @F.pandas_udf("array<long>")
    def held(names: pd.Series) -> pd.Series:
        return names.map(lambda s: _piece_keys(s, most, False))

    def keyed(df: DataFrame, name: str, pieces) -> DataFrame:
        # a pair with a short name is met among names of up to SHORT + most characters, any other among the long ones
        short = df.filter(F.length(name) <= SHORT + most).select(name, F.explode(variants(name)).alias("v")).select(name, F.xxhash64("v").alias("v"))
        return short.unionByName(df.filter(F.length(name) > SHORT).select(name, F.explode(pieces(name)).alias("v")))

    lone = left.select(F.col(column).alias("name")).dropna().distinct()
    goal = right.select(F.col(column).alias("near")).dropna().distinct()
    lone = lone.join(goal, lone["name"] == goal["near"], "left_anti")
    pairs = keyed(lone, "name", asked).join(keyed(goal, "near", held), "v").select("name", "near").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "near")).filter(F.col("distance") <= most)
