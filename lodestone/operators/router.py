"""Query routing: features of a text, its class, and the weights of dense, sparse and metadata scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.functions.text import tokens

# The words that the flags look for.
TEMPORAL = """2020 2021 2022 2023 2024 2025 2026 january february march april may june july august september october november
december spring summer autumn winter fall morning afternoon evening night today yesterday tomorrow last recent
一 二 三 四 五 六 七 八 九 十""".split()
LOCATION = "indoor outdoor inside outside street beach mountain forest city park garden kitchen living room office restaurant airport".split()
CATEGORY = "photo image picture painting sketch drawing portrait landscape".split()
NEGATION = "not no without except 除了 不 没有".split()
# Thresholds of class and weights.
CLASS_IDF, WEIGHT_IDF, LONG_QUERY = 3.0, 4.0, 6


def features(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """q_id, text, query_length, avg_idf, and the four flags. Without an index avg_idf is 0."""
    words = queries.withColumn("words", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")))
    flag = lambda known, name: F.arrays_overlap("words", F.array(*map(F.lit, known))).cast("int").alias(name)
    out = words.select("q_id", "text", F.size("words").alias("query_length"), flag(TEMPORAL, "has_temporal"), flag(LOCATION, "has_location"), flag(CATEGORY, "has_category"), flag(NEGATION, "has_negation"))
    if terms is None:
        return out.withColumn("avg_idf", F.lit(0.0))
    known = words.select("q_id", F.explode("words").alias("term")).join(terms.select("term", "idf"), "term").groupBy("q_id").agg(F.avg("idf").alias("avg_idf"))
    return out.join(known, "q_id", "left").withColumn("avg_idf", F.coalesce("avg_idf", F.lit(0.0)))


def _flags() -> Column:
    return F.col("has_temporal") + F.col("has_location") + F.col("has_category")


def query_class() -> Column:
    rare = F.col("avg_idf") >= CLASS_IDF
    return F.when((_flags() >= 1) & rare, "hybrid").when(_flags() >= 1, "metadata").when(rare, "keyword").otherwise("semantic")


def weights(defaults: tuple[float, float, float] = DEFAULT.weights) -> list[Column]:
    """w_dense, w_sparse, w_meta: the defaults and four adjustments, over their sum, not below 0."""
    rare, flags = (F.col("avg_idf") > WEIGHT_IDF).cast("double"), F.least(_flags(), F.lit(3)).cast("double")
    long, negated = (F.col("query_length") > LONG_QUERY).cast("double"), (F.col("has_negation") > 0).cast("double")
    raw = [
        F.lit(defaults[0]) - 0.10 * rare - 0.05 * flags + 0.10 * long - 0.10 * negated,
        F.lit(defaults[1]) + 0.15 * rare - 0.05 * flags - 0.05 * long + 0.10 * negated,
        F.lit(defaults[2]) - 0.05 * rare + 0.10 * flags - 0.05 * long,
    ]
    total = raw[0] + raw[1] + raw[2]
    return [F.greatest(F.lit(0.0), F.when(total > 0, w / total).otherwise(F.lit(d))).alias(n) for w, d, n in zip(raw, defaults, ("w_dense", "w_sparse", "w_meta"), strict=True)]


def routed(queries: DataFrame, terms: DataFrame | None = None, defaults: tuple[float, float, float] = DEFAULT.weights) -> DataFrame:
    return features(queries, terms).withColumn("query_type", query_class()).select("*", *weights(defaults))
