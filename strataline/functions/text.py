"""Identifier tokens and the lexical embedding, as Spark expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 256


def tokenize(text: Column) -> Column:
    """Lower-case subtokens longer than one character: split at lower-to-upper changes and non-alphanumerics. Null for null."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), lambda t: F.lower(t)), lambda t: F.length(t) > 1)


def token_buckets(token: Column, dim: int = DIM) -> Column:
    """Array of (bucket, sign): the two buckets of a token, both with one sign, from bytes of its MD5."""
    digest = F.md5(token)
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("int")
    sign = F.when(part(5, 2) % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    return F.array(
        F.struct((part(1, 4) % dim).alias("bucket"), sign.alias("sign")),
        F.struct((part(7, 4) % dim).alias("bucket"), sign.alias("sign")),
    )


def embed_sparse(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """key, bucket, weight: the non-zero entries of each text's unit vector. Texts without tokens have none."""
    tokens = df.select(F.col(key), F.explode(tokenize(F.col(text))).alias("token"))
    summed = tokens.select(key, F.explode(token_buckets(F.col("token"), dim)).alias("b")).groupBy(key, "b.bucket").agg(F.sum("b.sign").alias("weight"))
    norms = summed.groupBy(key).agg(F.sqrt(F.sum((F.col("weight") * F.col("weight")).cast("double"))).alias("norm"))
    return summed.filter("weight <> 0").join(norms, key).select(key, "bucket", (F.col("weight") / F.col("norm")).alias("weight"))


class LexicalEmbedder:
    """The same vector as embed_sparse gives, dense, for Arrow batches; tokens are hashed once."""

    def __init__(self, dim: int = DIM):
        self.id, self.dim = f"lexical-hash-{dim}", dim
        self._known: dict[str, tuple[int, int, int]] = {}

    def _hits(self, token: str) -> tuple[int, int, int]:
        if token not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            h = hashlib.md5(token.encode()).digest()
            self._known[token] = ((h[0] << 8 | h[1]) % self.dim, (h[3] << 8 | h[4]) % self.dim, 1 if h[2] & 1 else -1)
        return self._known[token]

    def embed(self, text: str) -> np.ndarray:
        vec = np.zeros(self.dim, np.float32)
        for token in _SPLIT.split(_HUMP.sub(r"\1 \2", text or "")):
            if len(token) > 1:
                a, b, sign = self._hits(token.lower())
                vec[a] += sign
                vec[b] += sign
        return vec / (float(np.sqrt(np.square(vec, dtype=np.float64).sum())) or 1.0)


_HUMP, _SPLIT = re.compile("([a-z0-9])([A-Z])"), re.compile("[^A-Za-z0-9]+")
_EMBEDDERS: dict = {}


def set_embedder(embedder, name: str = "default") -> None:
    """Register an object with id, dim and embed(text); it is sent to the workers with the job."""
    _EMBEDDERS[name] = embedder


def get_embedder(name: str = "default"):
    return _EMBEDDERS.setdefault(name, LexicalEmbedder())


def embed_texts(df: DataFrame, key: str, text: str, embedder=None) -> DataFrame:
    """key, dim, model, vec for each row by an embedder (the registered one); a null text is an empty one."""
    maker = embedder or get_embedder()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [maker.embed(t or "") for t in b.column(1).to_pylist()]
            flat = np.concatenate(vecs) if vecs else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * maker.dim), pa.array(flat.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(vecs), maker.dim, np.int32)), pa.array([maker.id] * len(vecs)), lists], names=[key, "dim", "model", "vec"])

    narrow = df.select(F.col(key), F.col(text))
    return narrow.mapInArrow(work, f"`{key}` {narrow.schema[0].dataType.simpleString()}, dim int, model string, vec array<float>")


def dot(a: Column, b: Column) -> Column:
    """Product over the shared length, in double; the cosine of unit vectors."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def signature(text: Column) -> Column:
    """The first line without blanks at its ends, at most 200 characters."""
    return F.substring(F.btrim(F.get(F.split(text, "\n"), F.lit(0)), F.lit(" \t\r\n")), 1, 200)
