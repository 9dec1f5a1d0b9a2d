"""Connected components of a table of links, by rounds of large and small stars.

Each round is two grouped minima and two joins, none of which gathers a node's neighbours. Rounds go on until the
links no longer change; every round's links are written to the shared folder, so lineage stays short and lost executors
cost one round. Those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, made, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Joins every larger neighbour to the least of a node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them. Links run from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(down).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached, for every node of the links (a, b); empty links give no rows."""
    with made() as had:
        now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        with made() as new_folders:
            now = stored(_small_star(_large_star(now)))
        discard(*had)
        had = new_folders
        new = _mark(now)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _mark(links: DataFrame) -> tuple:
    """Number and two sums of hashes of the links: equal as good as only if the links are."""
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(r)
