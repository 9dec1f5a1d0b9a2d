"""Operator 13: Lloyd's rounds by two cover trees, one over vectors and one over centroids.

Vectors lie in blocks, each a row of the stored table with its cover tree: a node's points are within its radius of its
centre, which is one of them; its children are centred on points more than half that power of two apart. Points are
stored in the tree's order, so a node's are a range. Every round makes a tree of the centroids and walks both trees from
their roots, level by level: a pair of nodes goes once all points of the one are surely nearer to another centroid than to
any of the other. A node that is left with one centroid gives its sum to it unseen; pairs of leaves are compared exactly.

Components are whole numbers, so sums and squared distances are exact; distances between centres are roots of such sums,
and a pair only goes beyond a margin for their rounding. Equal distances go to the centroid with the smaller number.

A task adds up its blocks and sends a row for each centroid. What reaches the driver is ``k`` times the width. Vectors of
another width, null ones and those with a null or non-finite component are left out. Repeated rows are vectors by
themselves; a null id hashes as empty text. Fewer vectors than ``k`` make as many centroids as there are; no vectors, no
rows. Components beyond 2^27 after scaling raise an error, as distances would not fit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, stored
from lodestone.session import importable

#: Vectors of a block, points of a leaf, and the largest component.
BLOCK, LEAF, LARGEST = 4096, 16, 1 << 27
#: Pairs of points or centres whose distances are computed at once.
AT_ONCE = 200_000


class Tree:
    """Nodes in breadth-first order: the range of points below each, its centre, radius, and the range of its children."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.order, self.radius = points, order, radius
        self.begin, self.end, self.centre, self.child, self.children = nodes.T

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        """``points`` are whole numbers, at least one row; those of the tree are in its own order."""
        order = np.arange(len(points))
        exact = points.astype(np.float64) if np.abs(points).max(initial=0) < 1 << 21 else points.astype(object)
        away = np.sqrt(_squares(exact - exact[0]))
        nodes, radius, todo, at = [[0, len(points), 0, 0, 0]], [float(away.max())], [(np.arange(len(points)), away)], 0
        while at < len(nodes):
            rows, away = todo[at]
            todo[at] = None
            if len(rows) > leaf and radius[at] > 0:
                half = 2.0 ** (np.ceil(np.log2(radius[at])) - 1)  # all lie within twice this of the centre, one beyond this
                nodes[at][3], begin = len(nodes), nodes[at][0]
                while len(rows):
                    near = away <= half
                    order[begin : begin + near.sum()] = rows[near]
                    nodes.append([begin, begin + int(near.sum()), int(rows[0]), 0, 0])
                    radius.append(float(away[near].max()))
                    todo.append((rows[near], away[near]))
                    begin += int(near.sum())
                    rows = rows[~near]
                    if len(rows):
                        away = np.sqrt(_squares(exact[rows] - exact[rows[0]]))
                nodes[at][4] = len(nodes) - nodes[at][3]
            at += 1
        nodes = np.array(nodes, np.int32)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        nodes[:, 2] = place[nodes[:, 2]]
        return cls(points[order], order, nodes, np.array(radius))

    def nodes(self) -> np.ndarray:
        return np.stack([self.begin, self.end, self.centre, self.child, self.children], 1)


def _squares(apart: np.ndarray) -> np.ndarray:
    return (apart * apart).sum(-1).astype(np.float64)


def _apart(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), AT_ONCE):
        x = a[at[i : i + AT_ONCE]] - b[to[i : i + AT_ONCE]]
        out[i : i + AT_ONCE] = np.einsum("ij,ij->i", x, x)
    return out


def _products(left_at: np.ndarray, left_n: np.ndarray, right_at: np.ndarray, right_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each two ranges, a range of the left after the other."""
    n = left_n * right_n
    k = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    wide = np.repeat(right_n, n)
    return np.repeat(left_at, n) + k // wide, np.repeat(right_at, n) + k % wide


def walk(vectors: Tree, centroids: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(first points, ends and centroids of whole nodes; the nearest centroid of each other point, -1 within whole nodes; distances computed)."""
    owner = np.full(len(vectors.points), -1, np.int64)
    owned: list[np.ndarray] = []
    v, c, computed = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    bound = np.array([np.inf])  # of each vector node in v: no point of it is farther than this from its nearest centroid
    while len(v):
        far = np.sqrt(_apart(vectors.points, vectors.centre[v], centroids.points, centroids.centre[c]).astype(np.float64))
        computed += len(v)
        order = np.lexsort((c, v))
        v, c, far, bound = v[order], c[order], far[order], bound[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        count = np.diff(np.r_[first, len(v)])
        best = np.minimum(np.minimum.reduceat(far + vectors.radius[v], first), np.minimum.reduceat(bound, first))
        bound = np.repeat(best, count)
        keep = far - vectors.radius[v] - centroids.radius[c] <= bound * (1 + 1e-9) + 1e-6
        v, c, bound = v[keep], c[keep], bound[keep]
        single = centroids.end[c] - centroids.begin[c] == 1
        alone = np.r_[True, v[1:] != v[:-1]] & np.r_[v[1:] != v[:-1], True] & single
        owned.append(np.stack([vectors.begin[v[alone]], vectors.end[v[alone]], centroids.begin[c[alone]]], 1))
        v, c, bound = v[~alone], c[~alone], bound[~alone]
        leaves = (vectors.children[v] == 0) & (centroids.children[c] == 0)
        deeper = np.zeros(len(v), bool)  # a vector leaf with any centroid node to open waits for it
        deeper[~leaves] = True
        if leaves.any() and deeper.any():
            waiting = np.isin(v, v[deeper])
            leaves &= ~waiting
        if leaves.any():
            computed += _compare(vectors, centroids, v[leaves], c[leaves], owner)
        v, c, bound = v[~leaves], c[~leaves], bound[~leaves]
        split_v, split_c = vectors.children[v] > 0, centroids.children[c] > 0
        at, n = np.where(split_v, vectors.child[v], v), np.where(split_v, vectors.children[v], 1)
        to, m = np.where(split_c, centroids.child[c], c), np.where(split_c, centroids.children[c], 1)
        bound = np.repeat(bound, n * m)
        v, c = _products(at.astype(np.int64), n.astype(np.int64), to.astype(np.int64), m.astype(np.int64))
    return *np.concatenate(owned).T.astype(np.int64), owner, computed


def _compare(vectors: Tree, centroids: Tree, v: np.ndarray, c: np.ndarray, owner: np.ndarray) -> int:
    """Settles the points of leaves against all the centroids that are left to them."""
    size = lambda tree, x: (tree.end[x] - tree.begin[x]).astype(np.int64)
    at, to = _products(vectors.begin[v].astype(np.int64), size(vectors, v), centroids.begin[c].astype(np.int64), size(centroids, c))
    apart, number = _apart(vectors.points, at, centroids.points, to), centroids.order[to]
    order = np.lexsort((number, apart, at))
    first = order[np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])]
    owner[at[first]] = to[first]
    return len(at)


def whole_vectors(df: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector: those of the width without null or non-finite components, floored after scaling."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & fine).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"))


def pack(vectors: DataFrame, dim: int) -> DataFrame:
    """The stored table of blocks with their trees."""
    importable(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()

    def close(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(parts)
        if points.size and np.abs(points).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} after scaling")
        tree = Tree.build(points, LEAF)
        ids = pa.concat_arrays(ids).take(pa.array(tree.order))
        data = [tree.points.astype("<i4").tobytes(), tree.nodes().astype("<i4").tobytes(), tree.radius.astype("<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in data)], ["ids", "points", "nodes", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, BLOCK - n)
                ids.append(some.column(0))
                parts.append(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64))
                at, n = at + some.num_rows, n + some.num_rows
                if n == BLOCK:
                    yield close(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield close(ids, parts)
        give_back()

    return stored(vectors.select("id", "vector").mapInArrow(run, f"ids array<{kind}>, points binary, nodes binary, radius binary"))


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        points = np.frombuffer(batch["points"][i].as_py(), "<i4").reshape(-1, dim).astype(np.int64)
        nodes = np.frombuffer(batch["nodes"][i].as_py(), "<i4").reshape(-1, 5)
        yield batch["ids"][i].values, Tree(points, np.arange(len(points)), nodes, np.frombuffer(batch["radius"][i].as_py(), "<f8"))


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: how many, and their componentwise sum. A task sends a row for each centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, count, total = Tree.build(centroids, 1), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, vectors in _trees(batch, dim):
                begin, end, of, owner, _ = walk(vectors, tree)
                before = np.concatenate([np.zeros((1, dim), np.int64), vectors.points.cumsum(0)])
                np.add.at(total, of, before[end] - before[begin])
                np.add.at(count, of, end - begin)
                seen = np.flatnonzero(owner >= 0)
                np.add.at(total, owner[seen], vectors.points[seen])
                count += np.bincount(owner[seen], minlength=k)
        some = np.flatnonzero(count)
        flat = pa.array(total[some].ravel(), pa.int64())
        at = pa.array(np.arange(len(some) + 1) * dim, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(tree.order[some], pa.int32()), pa.array(count[some], pa.int64()), pa.ListArray.from_arrays(at, flat)], ["cluster", "n", "total"])

    rows = blocks.select("ids", "points", "nodes", "radius").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    long = rows.select("cluster", F.posexplode(F.array_append(F.col("total"), F.col("n"))).alias("at", "x"))  # the count behind the components
    found: dict[int, list[int]] = {}
    for r in long.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        found.setdefault(r["cluster"], [0] * (dim + 1))[r["at"]] = int(r["x"])
    return {c: (x[-1], x[:-1]) for c, x in found.items()}


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector."""
    dim = centroids.shape[1]
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.build(centroids, 1)
        for batch in batches:
            for ids, vectors in _trees(batch, dim):
                begin, end, of, owner, _ = walk(vectors, tree)
                for a, b, c in zip(begin.tolist(), end.tolist(), of.tolist(), strict=True):
                    owner[a:b] = c
                apart = _apart(vectors.points, np.arange(len(owner)), tree.points, owner)
                yield pa.RecordBatch.from_arrays([ids, pa.array(tree.order[owner], pa.int32()), pa.array(apart, pa.int64())], ["id", "cluster", "distance"])

    return blocks.select("ids", "points", "nodes", "radius").mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    The first centroids are the vectors whose ids hash lowest; ``rounds`` times they move to the floored means of their
    vectors, those without vectors stay, and all vectors are assigned once more.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, dim, scale, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select("vector", key.alias("key")).orderBy("key", "vector").limit(k).collect()  # k rows
    out = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        none = spark.createDataFrame([], out)
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).join(none, "cluster").select("id", "cluster", "distance", *none.columns[1:])
    blocks = pack(vectors, dim)
    centroids = np.array([r["vector"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, total) in sums(blocks, centroids).items():
            centroids[c] = [x // n for x in total]
    found = stored(assign(blocks, centroids.copy()))
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, x, sum(inertia.values()), digest(centroids[c])) for c, x in inertia.items()], out)
    return found.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
