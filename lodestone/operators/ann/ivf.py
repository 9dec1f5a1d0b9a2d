"""Inverted lists with product quantisation: cells(cell, id, codes), searched in the nearest cells by table look-ups.

Lists are those of ``kmeans``: fitted on a sample where that is all there is, else moved by rounds over all vectors, in
two levels where there are many. Codebooks are of a size that parameters fix, and are fitted on the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators.ann import base
from lodestone.operators.ann.base import arrays_of, load, ranked, sample, save
from lodestone.operators.ann.kmeans import FLAT, Lists, distances, lists_of, lloyd, scaled, two_levels
from lodestone.operators.dense import best, matrix
from lodestone.operators.ranking import top
from lodestone.session import importable

#: Rows of a cell, about, and queries that meet at once.
CELL_BLOCK, QUERY_BLOCK = 4096, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = sums / np.maximum(n, 1)[:, None]
        centres[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


@dataclass
class IvfPq:
    """Unit vectors, so distance order is cosine order. Sizes are those of the parameters, not of the data."""

    centres: np.ndarray
    books: np.ndarray  # parts, codes, width of a part

    groups: np.ndarray | None = None  # centres of the upper level, where there are two

    @property
    def lists(self) -> Lists:
        return Lists(self.centres, self.groups)

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int | None = None, parts: int = DEFAULT.pq_parts, bits: int = DEFAULT.pq_bits, n_total: int | None = None, rounds: int = 4) -> IvfPq:
        x = scaled(sample(vectors))
        n = n_total or (len(x) if len(x) < base.SAMPLE else vectors.where("embedding IS NOT NULL").count())
        k, width = lists or lists_of(n, x.shape[1]), x.shape[1] // parts
        if width * parts != x.shape[1]:
            raise ValueError(f"{parts} parts don't divide width {x.shape[1]}")
        if n <= len(x):  # the sample is everything
            found = Lists(kmeans(x.copy(), k))
        elif k <= FLAT:
            found = lloyd(vectors, kmeans(x.copy(), k), rounds, unit=True)
        else:
            found = two_levels(vectors, k, rounds, unit=True)
        rest = x - found.centres[found.nearest(x)[0]]
        codes = max(1, min(1 << bits, len(x) // 4))
        return cls(found.centres, np.stack([kmeans(rest[:, i * width : (i + 1) * width].copy(), codes) for i in range(parts)]), found.groups)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"centres": self.centres, "books": self.books, **({} if self.groups is None else {"groups": self.groups})}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray]) -> IvfPq:
        return cls(arrays["centres"], arrays["books"], arrays.get("groups"))

    def save(self, path: str, cells: DataFrame) -> None:
        save({"cells": cells}, path, self.arrays(), kind="ivfpq")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[IvfPq, DataFrame]:
        """The index and its cells, ready to be searched."""
        return cls.of_arrays(arrays_of(spark, path)), load(spark, path)[0]["cells"]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.lists.nearest(x)[0]
        rest = x - self.centres[cell]
        width = self.books.shape[2]
        return cell, np.stack([nearest(rest[:, i * width : (i + 1) * width], book) for i, book in enumerate(self.books)], 1).astype(np.uint8)

    def cells(self, vectors: DataFrame) -> DataFrame:
        """id, cell, codes of every vector."""
        importable(vectors.sparkSession)

        def run(batches):
            for batch in batches:
                cell, codes = self.encode(scaled(matrix(batch["v"], self.centres.shape[1])))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "codes"])

        return vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, "id bigint, cell int, codes binary")

    def search(self, queries: DataFrame, vectors: DataFrame, cells: DataFrame, k: int, probe: int = DEFAULT.ivf_probe, refine: int = 20) -> DataFrame:
        """q_id, id, score, rank: ``refine`` * k candidates by quantised distance in the probed cells, then exact cosine."""
        return ranked(queries, self.candidates(queries, cells, k * refine, probe), vectors, k)

    def candidates(self, queries: DataFrame, cells: DataFrame, n: int, probe: int) -> DataFrame:
        probe = min(probe, len(self.centres))

        def probes(batches):
            for batch in batches:
                x = scaled(matrix(batch["v"], self.centres.shape[1]))
                near = self.lists.probes(x, probe)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["q_id"].to_numpy(), probe)), pa.array(near.ravel().astype(np.int32)), pa.array([r.tobytes() for r in np.repeat(x, probe, axis=0)], pa.binary())], ["q_id", "cell", "q"])

        asked = queries.where("embedding IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), F.col("embedding").alias("v")).mapInArrow(probes, "q_id bigint, cell int, q binary")
        # Lists are cut into parts of bounded size, so a cell that holds much of the data is spread over tasks; its queries go to each.
        size = cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("parts"))  # a row for each list
        size = F.broadcast(size)
        dealt = cells.join(size, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        sent = asked.join(size, "cell").select("q_id", "cell", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        centres, books = self.centres, self.books

        def scan(own: pa.Table, ask: pa.Table) -> pa.Table:
            found = {"q_id": [np.zeros(0, np.int64)], "id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
            if own.num_rows and ask.num_rows:
                ids, q_ids = own["id"].to_numpy(), ask["q_id"].to_numpy()
                codes = np.frombuffer(b"".join(own["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
                asked = np.frombuffer(b"".join(ask["q"].to_pylist())).reshape(len(q_ids), -1) - centres[own["cell"][0].as_py()]
                for at in range(0, len(q_ids), QUERY_BLOCK):
                    rest = asked[at : at + QUERY_BLOCK].reshape(-1, len(books), books.shape[2])
                    far = np.zeros((len(rest), len(ids)))
                    for part, book in enumerate(books):
                        far += distances(rest[:, part], book)[:, codes[:, part]]
                    row, place = best(-far, ids, n)
                    found["q_id"].append(q_ids[at + row])
                    found["id"].append(ids[place])
                    found["score"].append(-far[row, place])
            return pa.table({name: np.concatenate(parts) for name, parts in found.items()})

        met = dealt.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part"))
        return top(met.applyInArrow(scan, "q_id bigint, id bigint, score double"), n)
