"""Encoding of a whole corpus with a public tokenizer, as token ids or counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.bpe import Decoder, encoder_of, model_bytes, read_ranks
from strataline.session import table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids that are put together into one Arrow batch.
BATCH_IDS = 2_000_000


def shared_model(spark: SparkSession, vocabulary: str | None = None):
    """The model, built once on the driver; about 1 MB, fixed by the vocabulary, is broadcast."""
    return spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary or tokenizer_path(VOCABULARY))))


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Text that looks like a special token is plain text. A null and an empty text have an
    empty list. White space and odd characters are kept, so decoding gives the text back.
    One row for each row of ``df``, repeated ones too, also where the key is null; an empty
    table gives an empty result; other columns are not read.
    """
    if key == "ids":
        raise ValueError("the key may not be named ids")
    model = shared_model(df.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            first, held, ids = 0, 0, []
            for i in range(b.num_rows):
                ids.append(encoder.encode(texts[i].as_py()))
                held += len(ids[-1])
                if held >= BATCH_IDS or i + 1 == b.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), lists], names=[key, "ids"])
                    first, held, ids = i + 1, 0, []

    narrow = df.select(F.col(key), F.col(text))
    return narrow.mapInArrow(work, f"`{key}` {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens): as encode_corpus, but only the length of each list."""
    model = shared_model(df.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for b in batches:
            counts = [encoder.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    narrow = df.select(F.col(key), F.col(text))
    return narrow.mapInArrow(work, f"`{key}` {narrow.schema[0].dataType.simpleString()}, n_tokens long")


def decode_corpus(df: DataFrame, key: str, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text): the inverse of encode_corpus; an empty or null list gives an empty text."""
    model = shared_model(df.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for b in batches:
            texts = [decoder.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    narrow = df.select(F.col(key), F.col(ids))
    return narrow.mapInArrow(work, f"`{key}` {narrow.schema[0].dataType.simpleString()}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the length and hash of the text that its ids decode to."""
    back = decode_corpus(p6_ids(spark, sf_dir), "doc_id")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def p6_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and tokens per character for each language label."""
    docs = table(spark, sf_dir, "documents", "lang", "text")
    sized = token_counts(docs.withColumn("key", F.struct("lang", F.length("text").alias("n"))), "key", "text")
    return sized.groupBy(F.col("key.lang").alias("lang")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("key.n").alias("n_chars")
    )


def p6_lang_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each language label, and whether the tokens are at least a tenth and at most three times as many."""
    per = F.col("n_tokens") / F.col("n_chars")
    return p6_by_lang(spark, sf_dir).select("lang", "n_docs", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce((per >= 0.1) & (per <= 3), F.lit(True)).alias("plausible"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p6_by_lang": p6_by_lang, "p6_lang_totals": p6_lang_totals}
SQL = {
    "p6_lang_totals": "select lang, count(*) as n_docs, coalesce(sum(length(text)), 0)::bigint as n_chars, true as plausible from documents group by lang",
    "p6_round_trip": "select doc_id, length(coalesce(text, ''))::bigint as n_chars, md5(coalesce(text, '')) as text_md5 from documents",
}
