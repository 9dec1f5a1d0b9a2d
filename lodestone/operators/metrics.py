"""Ranking metrics on long tables: preds (q_id, rank, id), gold (q_id, id) or ``Classes``. Queries without predictions count as misses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.session import small, stored

KS = DEFAULT.ks


@dataclass
class Classes:
    """Gold by label: of a query (q_id, label) all items (id, label) of its label but itself. The pairs, which grow with the square of a class, are never made."""

    queries: DataFrame
    items: DataFrame

    @staticmethod
    def _sets(rows: DataFrame, key: str) -> DataFrame:
        """key, labels: usually one, all if a key has several rows."""
        return rows.where(F.col("label").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set("label")).alias("labels"))

    def marked(self, preds: DataFrame) -> DataFrame:
        """The predictions with their ``rel``."""
        asked, held = self._sets(self.queries, "q_id").withColumnRenamed("labels", "asked"), self._sets(self.items, "id")
        same = F.arrays_overlap("asked", "labels") & (F.col("q_id") != F.col("id"))
        return preds.join(held, "id", "left").join(asked, "q_id", "left").withColumn("rel", F.when(same, 1))

    def wanted(self) -> DataFrame:
        """q_id, wanted: from the sizes of the sets of labels that occur."""
        asked, held = self._sets(self.queries, "q_id").withColumnRenamed("labels", "asked"), self._sets(self.items, "id")
        kinds = asked.select("asked").distinct().withColumn("label", F.explode("asked"))
        sizes = held.groupBy("labels").agg(F.count("*").alias("n")).withColumn("label", F.explode("labels"))
        total = kinds.join(sizes, "label").select("asked", "labels", "n").distinct().groupBy("asked").agg(F.sum("n").alias("n"))
        own = asked.join(total, "asked").join(held.withColumnRenamed("id", "q_id"), "q_id", "left")
        return own.select("q_id", (F.col("n") - F.coalesce(F.arrays_overlap("asked", "labels").cast("int"), F.lit(0))).alias("wanted")).where("wanted > 0")


def _marked(preds: DataFrame, gold: DataFrame | Classes) -> DataFrame:
    if isinstance(gold, Classes):
        return gold.marked(preds)
    return preds.join(gold.select("q_id", "id").distinct().withColumn("rel", F.lit(1)), ["q_id", "id"], "left")


def judged(preds: DataFrame, gold: DataFrame | Classes) -> DataFrame:
    """q_id, rank, rel: 1 where the prediction is relevant."""
    return _marked(preds.select("q_id", "rank", "id"), gold).select("q_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def per_query(preds: DataFrame, gold: DataFrame | Classes, ks: tuple[int, ...] = KS) -> DataFrame:
    """Of every query with gold: hits at each k, reciprocal rank, and average precision by either divisor."""
    run = Window.partitionBy("q_id").orderBy("rank")
    seen = judged(preds, gold).withColumn("precision", F.sum("rel").over(run) / F.col("rank"))
    sums = seen.groupBy("q_id").agg(
        F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("precision") * F.col("rel")).alias("gain"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hits{k}") for k in ks],
    )
    wanted = gold.wanted() if isinstance(gold, Classes) else gold.select("q_id", "id").distinct().groupBy("q_id").agg(F.count("*").alias("wanted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return wanted.join(sums, "q_id", "left").select(
        "q_id", *[zero(f"hits{k}").alias(f"hits{k}") for k in ks], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.coalesce("gain", F.lit(0.0)) / F.greatest(zero("found"), F.lit(1))).alias("ap_retrieved"), (F.coalesce("gain", F.lit(0.0)) / F.col("wanted")).alias("ap_all"),
    )


def summary(preds: DataFrame, gold: DataFrame | Classes, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: recall and precision at each k, MAP by both divisors, MRR, number of queries. All in one pass."""
    q = per_query(preds, gold, ks)
    return q.agg(
        F.count("*").alias("n_queries"), *[F.avg((F.col(f"hits{k}") > 0).cast("double")).alias(f"recall_{k}") for k in ks],
        *[F.avg(F.col(f"hits{k}") / F.lit(k)).alias(f"precision_{k}") for k in ks], F.avg("ap_retrieved").alias("map_retrieved"), F.avg("ap_all").alias("map_all"), F.avg("rr").alias("mrr"),
    )


#: Bins of a group's histogram, and values that a bin may hold when they are sorted.
BINS, SORTED = 1024, 1_000_000


def percentiles(df: DataFrame, value: str, at: tuple[float, ...], *by: str) -> DataFrame:
    """by, p0, p1, ...: interpolated percentiles of each group, exact, without a buffer of its values.

    A histogram of equal bins between a group's least and greatest value tells which bins hold the wanted ranks; those that
    hold more than SORTED values are cut into bins again, until they don't or all their values are equal. A pass exchanges
    counts of bins; only the values of bins with wanted ranks are sorted. Nulls count for nothing; a group of nulls has nulls.
    Values must be finite.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_x"))
    ends = stored(rows.groupBy(*by).agg(F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    # lower and upper rank of each percentile, from 0, and the weight of the upper
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank"), w.alias("weight")) for i, p in enumerate(at) for r, w in ((F.floor(place(p)), 1 - (place(p) - F.floor(place(p)))), (F.ceil(place(p)), place(p) - F.floor(place(p))))])
    null = [F.lit(None).cast("double").alias(f"p{i}") for i in range(len(at))]
    wanted = (ends.where("_n > 0").select(*by, "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), F.explode(ranks).alias("r")).select(*by, "_low", "_high", "_below", "_in", "r.*"))
    sent = small if by else F.broadcast  # bins are at most two for each percentile of a group
    found = []
    while True:
        # a bin is settled where it is one value, or few
        one = F.col("_low") == F.col("_high")
        done = wanted.where(one).select(*by, "i", "weight", F.col("_low").alias("_x"))
        few = wanted.where(~one & (F.col("_in") <= SORTED))
        bins = few.select(*by, "_low", "_high", "_below").distinct()
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        within = F.col("a._x").between(F.col("b._low"), F.col("b._high"))
        join = lambda bins: rows.where("_x IS NOT NULL").alias("a").join(sent(bins).alias("b"), reduce(and_, [*same, within]))
        order = Window.partitionBy(*by, "_low", "_high", "_below").orderBy("_x")
        values = join(bins).select(*[F.col(f"b.{c}") for c in by], "b._low", "b._high", "b._below", "a._x").withColumn("rank", F.row_number().over(order) - 1 + F.col("_below"))
        keyed = values.alias("v").join(few.alias("f"), reduce(and_, [*[F.col(f"v.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by], F.col("v._low") == F.col("f._low"), F.col("v.rank") == F.col("f.rank")]))
        found += [done, keyed.select(*[F.col(f"f.{c}") for c in by], "f.i", "f.weight", "v._x")]
        many = wanted.where(~one & (F.col("_in") > SORTED))
        if many.isEmpty():
            break
        cut = join(many.select(*by, "_low", "_high", "_below").distinct()).select(*[F.col(f"b.{c}") for c in by], F.col("b._low").alias("_from"), F.col("b._high").alias("_to"), "b._below", "a._x")
        cut = cut.withColumn("_bin", F.least(F.floor((F.col("_x") - F.col("_from")) / F.greatest((F.col("_to") - F.col("_from")) / BINS, F.lit(5e-324))), F.lit(BINS - 1)))
        counts = cut.groupBy(*by, "_from", "_to", "_below", "_bin").agg(F.count("*").alias("_in"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        run = Window.partitionBy(*by, "_from", "_to", "_below").orderBy("_bin")
        counts = counts.withColumn("_start", F.col("_below") + F.sum("_in").over(run) - F.col("_in"))
        left = [*[F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by], F.col("m._low") == F.col("c._from"), F.col("m._high") == F.col("c._to"), F.col("m._below") == F.col("c._below"), F.col("m.rank") >= F.col("c._start"), F.col("m.rank") < F.col("c._start") + F.col("c._in")]
        wanted = stored(many.alias("m").join(counts.alias("c"), reduce(and_, left)).select(*[F.col(f"m.{c}") for c in by], "c._low", "c._high", F.col("c._start").alias("_below"), "c._in", "m.i", "m.rank", "m.weight"))
    sums = reduce(DataFrame.unionByName, found).groupBy(*by).agg(*[F.sum(F.when(F.col("i") == i, F.col("weight") * F.col("_x"))).alias(f"p{i}") for i in range(len(at))])
    return sums.unionByName(ends.where("_n = 0").select(*by, *null))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, population deviation, interpolated percentiles, least and most."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"), F.stddev_pop(value).alias("std_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    ranks = percentiles(df, value, (0.5, 0.95, 0.99), *by)
    both = out.alias("o").join(ranks.alias("r"), reduce(and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])) if by else out.crossJoin(ranks)
    return both.select(*[F.col(f"o.{c}") for c in by], "n", "mean_ms", "std_ms", F.col("p0").alias("p50_ms"), F.col("p1").alias("p95_ms"), F.col("p2").alias("p99_ms"), "min_ms", "max_ms")


def throughput_by(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n and calls a second of groups of calls one after the other, from their milliseconds; 0 where none took time."""
    spent = F.sum(value) / 1000
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.when(spent > 0, F.count(value) / spent).otherwise(0.0).alias("qps"))


def throughput(n_queries: int, seconds: float) -> float:
    return n_queries / seconds if seconds > 0 else 0.0
