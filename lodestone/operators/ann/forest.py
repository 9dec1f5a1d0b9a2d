"""A forest of random projection trees: leaves(tree, leaf, id), searched by equality of leaves in any tree.

The top of each tree is grown on a sample. Leaves that hold too many of all vectors are split by trees of their own, grown
on draws from their members, in rounds, so that leaves stay small whatever the table's size. These subtrees are a table with
a row for each split leaf; members of a leaf go down in parts of bounded size, its subtree to each part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators.ann.base import arrays_of, load, ranked, sample, save
from lodestone.operators.dense import matrix
from lodestone.session import importable, small, stored


@dataclass
class Tree:
    """Node i splits by normal[i] . x > offset[i] into children[i]; a child below 0 is leaf -child - 1."""

    normal: np.ndarray
    offset: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        if not len(self.normal):
            return at
        while True:
            live = np.flatnonzero(at >= 0)
            if not len(live):
                return -at - 1
            node = at[live]
            right = ((x[live] * self.normal[node]).sum(1) > self.offset[node]).astype(int)
            at[live] = self.children[node, right]


def grow(x: np.ndarray, leaf: int, seed: int) -> Tree:
    """Splits halfway between two drawn points until a leaf is small; points that can't be told apart stay together."""
    rng = np.random.default_rng(seed)
    normal, offset, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(x)), None)]
    while waiting:
        rows, parent = waiting.pop()
        side = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                n = a - b
                side = x[rows] @ n > n @ (a + b) / 2
                if 0.05 < side.mean() < 0.95:
                    break
                side = None
        if side is None:
            number, leaves = -leaves - 1, leaves + 1
        else:
            number = len(normal)
            normal.append(n)
            offset.append(n @ (a + b) / 2)
            children.append([0, 0])
            waiting += [(rows[~side], (number, 0)), (rows[side], (number, 1))]
        if parent:
            children[parent[0]][parent[1]] = number
    return Tree(np.array(normal), np.array(offset), np.array(children, np.int64).reshape(-1, 2))


#: Members that a split leaf's tree is grown on, about, and members that go down at once. Rounds of splitting, which a number's bits bound.
DRAWN, PART, ROUNDS = 4096, 20_000, 4
#: The number of a leaf at the top is its own behind a leading bit; that of a leaf below has its place in the subtree behind the split leaf's.
TOP_BITS, SUB_BITS = 14, 10
SUBTREES = "tree int, leaf bigint, normal binary, offset binary, children binary"


@dataclass
class Forest:
    trees: list[Tree]
    subtrees: DataFrame | None = None  # of split leaves; a stored table
    rounds: int = 0

    @classmethod
    def fit(cls, vectors: DataFrame, trees: int = DEFAULT.forest_trees, leaf: int = 40, seed: int = 42) -> Forest:
        """Planes come from the sample; a leaf of n rows in all then holds about leaf * n / sample rows, until ``split``."""
        x = sample(vectors)
        return cls([grow(x, leaf, seed + t) for t in range(trees)])

    def save(self, path: str, leaves: DataFrame) -> None:
        save(self.tables(leaves), path, self.arrays(), kind="forest", trees=len(self.trees), rounds=self.rounds)

    def tables(self, leaves: DataFrame) -> dict[str, DataFrame]:
        return {"leaves": leaves, **({} if self.subtrees is None else {"subtrees": self.subtrees})}

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"{name}_{t}": getattr(tree, name) for t, tree in enumerate(self.trees) for name in ("normal", "offset", "children")}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray], trees: int, subtrees: DataFrame | None = None, rounds: int = 0) -> Forest:
        return cls([Tree(*(arrays[f"{name}_{t}"] for name in ("normal", "offset", "children"))) for t in range(trees)], subtrees, rounds)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[Forest, DataFrame]:
        """The trees and their leaves, ready to be searched."""
        tables, manifest = load(spark, path)
        return cls.of_arrays(arrays_of(spark, path), manifest["trees"], tables.get("subtrees"), manifest["rounds"]), tables["leaves"]

    def leaves(self, vectors: DataFrame, key: str = "id") -> DataFrame:
        """key, tree, leaf of every vector."""
        importable(vectors.sparkSession)
        trees = self.trees

        def run(batches):
            for batch in batches:
                x, ids = matrix(batch["v"]), batch["key"]
                for t, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), t), pa.int32()), pa.array(tree.leaves(x) | 1 << TOP_BITS, pa.int64())], [key, "tree", "leaf"])

        found = vectors.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.col("embedding").alias("v")).mapInArrow(run, f"{key} bigint, tree int, leaf bigint")
        for _ in range(self.rounds):
            found = descended(found, vectors, self.subtrees, key)
        return found

    def split(self, vectors: DataFrame, bound: int) -> tuple[Forest, DataFrame]:
        """The forest and its leaves, none of which has more than ``bound`` vectors, but for those that can't be told apart by DRAWN of them."""
        leaves, grown, seen = stored(self.leaves(vectors)), [], []
        for turn in range(ROUNDS):
            size = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > bound)
            for had in seen:  # that gave no tree
                size = size.join(had, ["tree", "leaf"], "left_anti")
            long = stored(size)
            if long.isEmpty():
                break
            share = F.ceil(F.col("n") / DRAWN)
            drawn = leaves.join(small(long), ["tree", "leaf"]).where(F.pmod(F.xxhash64("id", "tree", F.lit(turn)), share) == 0)
            drawn = drawn.join(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "id").select("tree", "leaf", "n", "id", "embedding")

            def run(rows: pa.Table) -> pa.Table:
                rows = rows.sort_by("id").combine_chunks()
                x = matrix(rows["embedding"].chunk(0)).astype(np.float32).astype(np.float64)
                each = max(8, int(bound / 2 * len(x) / rows["n"][0].as_py()))  # noqa: B023
                tree = grow(x, each, rows["tree"][0].as_py() + rows["leaf"][0].as_py() % 100_003)
                if not 1 < len(tree.normal) + 1 < 1 << SUB_BITS:
                    tree = Tree(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros((0, 2), np.int64))
                data = [tree.normal.astype("<f4").tobytes(), tree.offset.astype("<f8").tobytes(), tree.children.astype("<i8").tobytes()]
                return pa.table([rows["tree"][:1], rows["leaf"][:1], *(pa.array([d], pa.binary()) for d in data)], ["tree", "leaf", "normal", "offset", "children"])

            trees = stored(drawn.groupBy("tree", "leaf").applyInArrow(run, SUBTREES))
            seen.append(trees.where("length(offset) = 0").select("tree", "leaf"))
            fine = trees.where("length(offset) > 0")
            grown.append(fine)
            keys = fine.select("tree", "leaf")
            stay, go = leaves.join(small(keys), ["tree", "leaf"], "left_anti"), leaves.join(small(keys), ["tree", "leaf"], "left_semi")
            leaves = stored(stay.select("id", "tree", "leaf").unionByName(descended(go, vectors, fine, "id", long)))
        if not grown:
            return Forest(self.trees), leaves
        return Forest(self.trees, stored(reduce(DataFrame.unionByName, grown)), len(grown)), leaves

    def search(self, queries: DataFrame, vectors: DataFrame, leaves: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        met = self.leaves(queries, "q_id").join(leaves, ["tree", "leaf"]).select("q_id", "id")
        return ranked(queries, met, vectors, k, metric)


def descended(rows: DataFrame, vectors: DataFrame, subtrees: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """key, tree, leaf one level further down, where the leaf was split. ``sizes`` (tree, leaf, n) tells how many parts a leaf's members make."""
    parts = subtrees.withColumn("parts", F.lit(1)) if sizes is None else subtrees.join(small(sizes.select("tree", "leaf", F.ceil(F.col("n") / PART).cast("int").alias("parts"))), ["tree", "leaf"])
    known = parts.select("tree", "leaf", "parts")
    own = rows.join(small(known), ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64(key), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = own.join(vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").alias("v")), key)
    sent = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(members: pa.Table, tree: pa.Table) -> pa.Table:
        members = members.combine_chunks()
        leaf = members["leaf"]
        if members.num_rows and tree.num_rows:
            x = matrix(members["v"].chunk(0)).astype(np.float32).astype(np.float64)
            sub = Tree(np.frombuffer(tree["normal"][0].as_py(), "<f4").reshape(-1, x.shape[1]).astype(np.float64), np.frombuffer(tree["offset"][0].as_py(), "<f8"), np.frombuffer(tree["children"][0].as_py(), "<i8").reshape(-1, 2))
            leaf = pa.array(leaf.to_numpy() << SUB_BITS | sub.leaves(x), pa.int64())
        return pa.table([members[key], members["tree"], leaf], [key, "tree", "leaf"])

    return own.groupBy("tree", "leaf", "part").cogroup(sent.groupBy("tree", "leaf", "part")).applyInArrow(run, f"{key} bigint, tree int, leaf bigint")
