"""Neighbour graphs of whole tables, maps that are drawn from them in rounds, and how far a map can be trusted.

1. Graph: trees deal the vectors into leaves of bounded size; the members of a leaf are compared with each other in one
   task, and each vector keeps its nearest over all trees. What is exchanged is a vector and k edges for each tree.
2. Weights: each vector's distances become fuzzy memberships, and those of both directions are joined.
3. Map: it begins with the places that ``reduce.NeighbourMap`` gives by its sample. In every round the vectors lie in
   blocks by a hash of their id, which meet the present places of their neighbours; a block pulls each vector to its
   neighbours and pushes it from drawn places, in small steps. Neighbours stay where they are within a round.

Nulls have no neighbours and no place. Repeated vectors are neighbours at distance 0, ties go by id. Ids are distinct integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import dense, reduce
from lodestone.operators.ann.forest import Forest
from lodestone.operators.ann.ivf import distances
from lodestone.session import importable, small, stored

#: Trees and members of a leaf about, which bound what a vector is compared with. A leaf that can't be split is cut.
TREES, LEAF, MOST = 8, 200, 2000
#: Vectors of a block of the map, places that are drawn to push from, rounds, and steps in each.
BLOCK, DRAWN, ROUNDS, STEPS = 5000, 2000, 6, 8


def graph(vectors: DataFrame, k: int = 15, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """id, other, far: the k nearest of each vector (id, embedding) among those that share a leaf with it, by Euclidean distance."""
    importable(vectors.sparkSession)
    have = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    _, leaves = Forest.fit(have, trees, leaf).split(have, 2 * leaf)
    size = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / MOST).cast("int").alias("parts"))
    # Vectors that no tree can tell apart are dealt out by id, differently in each tree.
    dealt = leaves.join(size, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts")).drop("parts")

    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by("id").combine_chunks()
        ids = members["id"].to_numpy()
        if len(ids) < 2:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
        x, found = dense.matrix(members["embedding"].chunk(0)), []
        for at in range(0, len(ids), 256):
            s = -np.sqrt(np.maximum(0, distances(x[at : at + 256], x)))
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            row, col = dense.best(s, ids, k)
            found.append((ids[at + row], ids[col], -s[row, col]))
        own, other, far = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"id": own, "other": other, "far": far})

    met = dealt.join(have, "id").groupBy("tree", "leaf", "part").applyInArrow(run, "id bigint, other bigint, far double")
    each = met.groupBy("id", "other").agg(F.min(F.round("far", 9)).alias("far"))
    nearest = Window.partitionBy("id").orderBy("far", "other")
    return each.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n")


def weights(edges: DataFrame) -> DataFrame:
    """id, other, w: of both directions, a + b - ab of the memberships."""
    near = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("near"))  # k of each

    def run(batches):
        for batch in batches:
            ids, near = batch["id"].to_numpy(zero_copy_only=False), batch["near"]
            sizes = near.value_lengths().to_numpy(zero_copy_only=False)
            flat = near.flatten()
            far, other = flat.field("far").to_numpy(zero_copy_only=False), flat.field("other").to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                places = starts[at][:, None] + np.arange(n)
                w = reduce._weights(far[places], np.log2(n + 1), False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], n)), pa.array(other[places].ravel()), pa.array(w.ravel())], ["id", "other", "w"])

    one = near.mapInArrow(run, "id bigint, other bigint, w double")
    both = one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "w"))
    total, times = F.sum("w"), F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0)
    return both.groupBy("id", "other").agg((total - times).alias("w"))


def _moved(own: np.ndarray, place: np.ndarray, there: np.ndarray, w: np.ndarray, drawn: np.ndarray, rate: float, steps: int, rng: np.random.Generator) -> np.ndarray:
    """The block's places after some steps: ``own`` numbers the rows of ``place`` that edges to ``there`` begin at."""
    y = place.copy()
    for s in range(steps):
        use = rng.random(len(w)) < w
        i = own[use]
        d = y[i] - there[use]
        move = np.clip(-2 / (1 + (d**2).sum(1, keepdims=True)) * d, -4, 4)
        for _ in range(3):
            e = y[i] - drawn[rng.integers(len(drawn), size=len(i))]
            square = (e**2).sum(1, keepdims=True)
            move += np.clip(2 / ((0.001 + square) * (1 + square)) * e, -4, 4) / 3
        step = np.zeros_like(y)
        np.add.at(step, i, move)
        n = np.bincount(i, minlength=len(y))[:, None]
        y += rate * (1 - s / steps) * step / np.maximum(n, 1)
    return y


def drawn_map(vectors: DataFrame, n: int = 2, k: int = 15, rounds: int = ROUNDS, seed: int = 42, edges: DataFrame | None = None) -> DataFrame:
    """id, embedding: the place of every vector (id, embedding) in n dimensions."""
    have = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    joined = stored(weights(stored(graph(have, k)) if edges is None else edges))
    places = stored(reduce.NeighbourMap.fit(have, n, "umap").transform(have).withColumn("embedding", F.col("embedding").cast("array<double>")))
    blocks = max(1, -(-places.count() // BLOCK))
    for turn in range(rounds):
        drawn = np.array([r[0] for r in places.orderBy(F.xxhash64("id", F.lit(seed + turn))).limit(DRAWN).select("embedding").collect()], np.float64)
        met = joined.join(places.select(F.col("id").alias("other"), F.col("embedding").alias("there")), "other")
        block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).alias("block")
        rate = 1 - turn / rounds

        def run(members: pa.Table, edges: pa.Table) -> pa.Table:
            members = members.sort_by("id").combine_chunks()
            if not members.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], ["id", "embedding"])
            ids, y = members["id"].to_numpy(), dense.matrix(members["embedding"].chunk(0))
            if edges.num_rows:
                edges = edges.sort_by([("id", "ascending"), ("other", "ascending")]).combine_chunks()  # whatever order they came in
                rng = np.random.default_rng([seed, turn, int(ids[0])])  # noqa: B023
                y = _moved(np.searchsorted(ids, edges["id"].to_numpy()), y, dense.matrix(edges["there"].chunk(0)), edges["w"].to_numpy(), drawn, rate, STEPS, rng)  # noqa: B023
            return pa.table([members["id"], pa.array(list(y), pa.list_(pa.float64()))], ["id", "embedding"])

        own = places.select("id", "embedding", block).groupBy("block")
        places = stored(own.cogroup(met.select("id", "other", "w", "there", block).groupBy("block")).applyInArrow(run, "id bigint, embedding array<double>"))
    return places


def trust(vectors: DataFrame, places: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """q_id, penalty: by how many ranks, in all, the k nearest of each query (q_id) on the map are further off than k among the vectors.

    ``vectors`` and ``places`` are (id, embedding). The rank of a vector is 1 and the number of vectors that are nearer, at
    nine places. Every vector is compared, in blocks; of each pair of blocks k counts a query remain.
    """
    importable(vectors.sparkSession)
    asked = places.join(queries.select(F.col("q_id").alias("id")), "id", "left_semi").select(F.col("id").alias("q_id"), "embedding")
    near = stored(dense.exact_topk(asked, places, k, "euclidean", exclude_self=True).select("q_id", "id"))
    own = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = own.join(small(queries.select(F.col("q_id").alias("id"))), "id", "left_semi").select(F.col("id").alias("q_id"), F.col("embedding").alias("q"))
    far = F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    limits = near.join(own, "id").join(asked, "q_id").groupBy("q_id").agg(F.collect_list(F.round(far, 9)).alias("limits"))
    # The limits stand behind the query's vector; those that are missing are below any distance.
    filled = F.concat("limits", F.array_repeat(F.lit(-1.0), F.lit(k) - F.size("limits")))
    ask = dense._packed(asked.join(limits, "q_id").select(F.col("q_id").alias("id"), F.concat("q", filled).alias("v")), 256, ("q_ids", "q"))
    have = dense._packed(own.select("id", F.col("embedding").alias("v")), dense.VECTOR_BLOCK, ("ids", "m"))

    def run(batches):
        for batch in batches:
            for q_ids, q, ids, m in zip(*(batch[c] for c in ("q_ids", "q", "ids", "m")), strict=True):
                asked, known = np.array(q_ids.as_py(), np.int64), np.array(ids.as_py(), np.int64)
                q, x = np.frombuffer(q.as_py()).reshape(len(asked), -1), np.frombuffer(m.as_py()).reshape(len(known), -1)
                far = np.round(-dense.similarity(q[:, :-k], x, "euclidean"), 9)
                far[asked[:, None] == known[None, :]] = np.inf
                nearer = np.stack([(far < q[:, j - k, None]).sum(1) for j in range(k)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(list(nearer.astype(np.int64)), pa.list_(pa.int64()))], ["q_id", "nearer"])

    pairs = have.crossJoin(F.broadcast(ask) if dense.is_small(queries, dense.SENT_QUERIES) else ask.hint("shuffle_replicate_nl"))
    counts = pairs.mapInArrow(run, "q_id bigint, nearer array<bigint>").groupBy("q_id").agg(*[F.sum(F.get("nearer", F.lit(j))).alias(f"n{j}") for j in range(k)])
    return counts.select("q_id", sum((F.greatest(F.col(f"n{j}") + 1 - k, F.lit(0)) for j in range(k)), F.lit(0)).cast("long").alias("penalty"))


def trustworthiness(vectors: DataFrame, places: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """n_queries, trust: 1 where no query has a neighbour on the map that isn't one, after Venna and Kaski; about 0.5 for a map at random."""
    n = vectors.where("embedding IS NOT NULL").count()
    worst = k * (2 * n - 3 * k - 1) / 2
    mean = 1 - F.avg("penalty") / F.lit(worst) if worst > 0 else F.lit(None).cast("double")
    return trust(vectors, places, queries, k).agg(F.count("*").alias("n_queries"), mean.alias("trust"))
