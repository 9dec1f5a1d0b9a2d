"""Dimension reduction: centred PCA, and maps of neighbours (umap, tsne).

A map of neighbours is laid out for a bounded sample on the driver, and every vector is then placed among its nearest
ones of the sample, on the executors; what is sent to them is the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ann.base import sample
from lodestone.operators.ann.ivf import distances
from lodestone.operators.dense import matrix
from lodestone.session import importable

METHODS = ("pca", "umap", "tsne")
#: Vectors that a map is laid out for, at most; the exact forces of tsne are quadratic in them.
SAMPLES = {"umap": 4000, "tsne": 1000}


@dataclass
class Reducer:
    scaler: object
    pca: object

    @classmethod
    def fit(cls, vectors: DataFrame, n: int, method: str = "pca") -> Reducer:
        if method != "pca":
            raise ValueError(f"{method}: see fitted()")
        rows = vectors.where("embedding IS NOT NULL").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
        scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(rows)
        return cls(scaler, PCA(k=n, inputCol="centred", outputCol="out").fit(scaler.transform(rows)))

    def transform(self, vectors: DataFrame) -> DataFrame:
        """The same rows with ``embedding`` reduced."""
        rows = vectors.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>")))
        out = self.pca.transform(self.scaler.transform(rows))
        return out.withColumn("embedding", vector_to_array("out", "float32")).drop("raw", "centred", "out")

    @property
    def explained(self) -> list[float]:
        return self.pca.explainedVariance.toArray().tolist()


def _weights(far: np.ndarray, total: float, entropy: bool) -> np.ndarray:
    """Rows of exp(-(d - least) / s), with s searched so that each has the given sum, or the given perplexity."""
    shifted = far - far.min(1, keepdims=True)
    low, high = np.full(len(far), 1e-12), np.full(len(far), 1e12)
    for _ in range(64):
        s = np.sqrt(low * high)
        w = np.exp(-shifted / s[:, None])
        if entropy:
            p = w / w.sum(1, keepdims=True)
            reached = np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1))
        else:
            reached = w.sum(1)
        low, high = np.where(reached < total, s, low), np.where(reached < total, high, s)
    return w


def _start(x: np.ndarray, n: int) -> np.ndarray:
    """The first principal directions, narrow."""
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    y = np.zeros((len(x), n))
    y[:, : min(n, len(axes))] = centred @ axes[:n].T
    return y / (np.abs(y).max() + 1e-10)


def umap_layout(x: np.ndarray, n: int, neighbours: int = 15, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """A fuzzy graph of nearest neighbours, drawn by pulling its edges and pushing random pairs apart, less and less."""
    rng, k = np.random.default_rng(seed), min(neighbours, len(x) - 1)
    y = 10 * _start(x, n)
    if k < 1:
        return y
    far = distances(x, x)
    np.fill_diagonal(far, np.inf)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    w = _weights(np.sqrt(np.take_along_axis(far, near, 1)), np.log2(k + 1), False)
    graph = np.zeros((len(x), len(x)), np.float32)
    np.put_along_axis(graph, near, w.astype(np.float32), 1)
    graph = graph + graph.T - graph * graph.T
    a, b = np.nonzero(graph)
    chance = graph[a, b]
    for r in range(rounds):
        rate = 1.0 - r / rounds
        use = rng.random(len(a)) < chance
        i, j = a[use], b[use]
        d = y[i] - y[j]
        pull = np.clip(-2 / (1 + (d**2).sum(1, keepdims=True)) * d, -4, 4)
        np.add.at(y, i, rate * pull)
        np.add.at(y, j, -rate * pull)
        for _ in range(3):
            other = rng.integers(len(x), size=len(i))
            d = y[i] - y[other]
            square = (d**2).sum(1, keepdims=True)
            push = np.clip(2 / ((0.001 + square) * (1 + square)) * d, -4, 4)
            np.add.at(y, i, rate * push)
    return y


def tsne_layout(x: np.ndarray, n: int, perplexity: float = 30.0, rounds: int = 400) -> np.ndarray:
    """Points whose Student-t similarities are like the Gaussian ones of the vectors, by gradient descent with momentum."""
    y = 1e-2 * _start(x, n)
    if len(x) < 3:
        return y
    far = distances(x, x)
    np.fill_diagonal(far, np.inf)
    p = _weights(far, min(perplexity, (len(x) - 1) / 3), True)
    np.fill_diagonal(p, 0)
    p /= p.sum(1, keepdims=True)
    p = np.maximum((p + p.T) / (2 * len(x)), 1e-12)
    speed, rate = np.zeros_like(y), max(50.0, len(x) / 12)
    for r in range(rounds):
        q = 1 / (1 + distances(y, y))
        np.fill_diagonal(q, 0)
        force = ((12 if r < 100 else 1) * p - np.maximum(q / q.sum(), 1e-12)) * q
        gradient = 4 * (force.sum(1)[:, None] * y - force @ y)
        speed = (0.5 if r < 100 else 0.8) * speed - rate * gradient
        y = y + speed
        y -= y.mean(0)
    return y


@dataclass
class NeighbourMap:
    """A sample and where it was laid out."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, n: int, method: str) -> NeighbourMap:
        x = sample(vectors, SAMPLES[method])
        return cls(x, (umap_layout if method == "umap" else tsne_layout)(x, n) if len(x) else np.zeros((0, n)))

    def transform(self, vectors: DataFrame, nearest: int = 5) -> DataFrame:
        """The same rows with ``embedding`` placed at the mean of the nearest ones of the sample, the nearer the heavier."""
        importable(vectors.sparkSession)
        names = vectors.columns
        at, k = names.index("embedding"), min(nearest, len(self.x))

        def run(batches):
            for batch in batches:
                column = batch.column(at)
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                out: list = [None] * len(column)
                for first in range(0, len(known) if k else 0, 1024):
                    rows = known[first : first + 1024]
                    far = np.sqrt(distances(matrix(column.take(pa.array(rows)), self.x.shape[1]), self.x))
                    near = np.argpartition(far, k - 1, axis=1)[:, :k]
                    w = 1 / (np.take_along_axis(far, near, 1) + 1e-6) ** 2
                    placed = (w[:, :, None] * self.y[near]).sum(1) / w.sum(1)[:, None]
                    for row, v in zip(rows.tolist(), placed.astype(np.float32), strict=True):
                        out[row] = v
                columns = list(batch.columns)
                columns[at] = pa.array(out, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(columns, names)

        kinds = ", ".join(f"`{f.name}` {'array<float>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in vectors.schema.fields)
        return vectors.mapInArrow(run, kinds)


def fitted(vectors: DataFrame, n: int, method: str = "pca") -> Reducer | NeighbourMap:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return Reducer.fit(vectors, n) if method == "pca" else NeighbourMap.fit(vectors, n, method)


def compare(vectors: DataFrame, dims: tuple[int, ...]) -> list[dict]:
    """For each width the share of variance that is kept."""
    return [{"method": "pca", "dim": n, "explained": sum(Reducer.fit(vectors, n).explained)} for n in dims]
