"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, class_lm, decontaminate, dual_tree, importance, langid, pii, quality, secrets, simhash, sql, substring_dedup, token_counts, word_bpe
from lodestone.llm.common import crc_bucket, table

RANKS, TOKENIZER, WORDS = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"
MAX_TOKENS = 1024
#: Whose words count as easy to guess.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = class_lm.fit_and_score(docs, crc_bucket(F.col("doc_id"), 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k.name).alias(f"n_{k.name}") for k in pii.KINDS[: pii.BASE]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.joined(base_only=True), 256).alias("base_sha256"), pii.joined().alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs).select(F.col("id").alias("doc_id"), *counts, "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = token_counts.prefix_counts(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, MAX_TOKENS, differences=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, words=secrets.vocabulary(map(public_tokenizers.path, VOCABULARIES)))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.KINDS[:3]
    return found.select(F.col("id").alias("doc_id"), *map(of, base), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined().alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "n_windows")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS)).withColumnRenamed("id", "doc_id")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_class_lm, op2_language_id, op3_byte_bpe, op4_pii, op5_quality_rules, op6_token_counts, op7_substring_dedup, op8_simhash, op9_secret_scan, op10_decontamination, op11_importance, op12_word_bpe, op13_dual_tree)}


def oracle_sql() -> dict[str, str]:
    return {"op4_pii": sql.OP4, "op5_quality_rules": sql.OP5, "op7_substring_dedup": sql.OP7, "op10_decontamination": sql.OP10, "op11_importance": sql.OP11, "op13_dual_tree": sql.op13()}
