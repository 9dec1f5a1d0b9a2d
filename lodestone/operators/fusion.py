"""Score fusion over aligned candidates; every statistic is one of a query's own candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT

FLAT = 1e-10


def minmax(score: str, group: str = "q_id") -> Column:
    """0 to 1 within the query; 0 where all scores are the same."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < FLAT, 0.0).otherwise((F.col(score) - low) / (high - low))


def zscore(score: str, group: str = "q_id") -> Column:
    """Distance from the mean in population deviations; 0 where all scores are the same."""
    w = Window.partitionBy(group)
    mean, spread = F.avg(score).over(w), F.stddev_pop(score).over(w)
    return F.when(spread < FLAT, 0.0).otherwise((F.col(score) - mean) / spread)


def calibrated(df: DataFrame, columns: list[str], method: str = "minmax", group: str = "q_id") -> DataFrame:
    if method not in ("minmax", "zscore"):
        raise ValueError(f"unknown method {method!r}; minmax or zscore")
    return df.select("*", *[(minmax if method == "minmax" else zscore)(c, group).alias(f"{c}_cal") for c in columns])


def aligned(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """q_id, id, dense, sparse: a candidate of one side only has 0 on the other."""
    left, right = dense.select("q_id", "id", F.col("score").alias("dense")), sparse.select("q_id", "id", F.col("score").alias("sparse"))
    return left.join(right, ["q_id", "id"], "full_outer").select("q_id", "id", F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"))


def weighted(candidates: DataFrame, w_dense, w_sparse, w_meta=None) -> DataFrame:
    """Adds ``score``: the weighted sum of min-max scores. Weights are numbers or columns and are not normalised."""
    of = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    score = of(w_dense) * minmax("dense") + of(w_sparse) * minmax("sparse")
    if w_meta is not None:
        score = score + of(w_meta) * minmax("meta")
    return candidates.withColumn("score", score)


def rrf(rankings: list[DataFrame], k: int = DEFAULT.rrf_k) -> DataFrame:
    """q_id, id, score: the sum over rankings (q_id, id, rank) of 1 / (k + rank)."""
    every = reduce(DataFrame.unionByName, [r.select("q_id", "id", "rank") for r in rankings])
    return every.groupBy("q_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
