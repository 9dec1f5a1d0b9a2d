"""Ranks, cut-offs, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored


def top(df: DataFrame, k: int, by: str = "score", group: tuple[str, ...] = ("q_id",), tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1. The limit is pushed below the shuffle.

    Scores are compared at nine places, ties go by id, so the order doesn't depend on how sums were split.
    """
    order = Window.partitionBy(*group).orderBy(F.round(by, 9).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Sorted distinct keys numbered from 0. Numbers come from sizes of sorted ranges, not from one global window.

    The ranges are stored, so that both readings of them have the same edges.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id())
    local = stored(keys).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = local.groupBy("part").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("part", "before")), "part").select(key, (F.col("before") + F.col("n") - 1).alias(name))


def positional_split(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Adds ``split``: train for the first floor(share * n) rows in order of distinct keys, test for the others."""
    numbered = df.join(dense_index(df, key, "_place"), key, "left")
    total = df.select(key).where(F.col(key).isNotNull()).distinct().agg(F.count("*").alias("_total"))
    told = numbered.crossJoin(F.broadcast(total))  # one row
    return told.withColumn("split", F.when(F.col("_place") < F.floor(F.col("_total") * share), "train").otherwise("test")).drop("_place", "_total")


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) of each key, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0


def group_split(df: DataFrame, key: str, validation: float = 0.2, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``; rows of a key stay together. No join and no shuffle."""
    share = hash_share(F.col(key), seed)
    return df.withColumn("split", F.when(share < test, "test").when(share < test + validation, "val").otherwise("train"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def first_of_group(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(value, order).alias(value))


def head_of_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    place = Window.partitionBy(group).orderBy(order)
    return df.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= n)
