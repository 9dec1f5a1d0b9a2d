"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, decontaminate, langid, secrets, simhash
from lodestone.llm.common import map_rows, table
from lodestone.llm.queries import RANKS, VOCABULARIES


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language, and labels those that had no label; null texts and texts without a letter go."""
    return langid.keep_identified(docs, langid.learn(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with the values of its secrets replaced; n_chars follows where a text changed."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars")
    sent = spark.sparkContext.broadcast(secrets.Guesser(secrets.vocabulary(map(public_tokenizers.path, VOCABULARIES))))  # as large as the vocabularies

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, sizes = batch.column(at).to_pylist(), batch.column(chars).to_pylist()
            clean = [secrets.redacted(t, sent.value) for t in texts]
            sizes = [n if new == old else len(new) for n, old, new in zip(sizes, texts, clean, strict=True)]
            columns = list(batch.columns)
            columns[at], columns[chars] = pa.array(clean, pa.string()), pa.array(sizes, batch.column(chars).type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return apply

    return map_rows(docs, start, docs.schema)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes that they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
