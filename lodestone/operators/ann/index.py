"""One face for all indexes: flat, ivfpq, graph (also called hnsw), lsh and forest."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import trees_for
from lodestone.functions.vectors import checked
from lodestone.operators import dense
from lodestone.operators.ann import base, forest, graph, ivf, lsh
from lodestone.session import discard, made, shared_folder, stored

KINDS = {"flat": "flat", "ivfpq": "ivfpq", "graph": "graph", "hnsw": "graph", "lsh": "lsh", "forest": "forest", "annoy": "forest"}


class VectorIndex:
    """Built from vectors (id, embedding) into a folder of tables, and searched from there, also by another session.

    The folder is one of spark.checkpoint.dir unless one is given; then it stays.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.tables, self.manifest = base.load(spark, path)
        self.arrays = base.arrays_of(spark, path)

    @classmethod
    def build(cls, vectors: DataFrame, kind: str = "flat", path: str | None = None, **parameters) -> VectorIndex:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
        kind, spark, path = KINDS[kind], vectors.sparkSession, path or shared_folder(vectors.sparkSession)
        first = vectors.where("embedding IS NOT NULL").select(F.size("embedding")).first()
        width = first[0] if first else 0
        # Stored with the check, so a vector of another width ends the build.
        rows, normals = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), checked(F.col("embedding"), width).alias("embedding")), None
        if kind == "lsh":  # the buckets lie beside their vectors, so that a search exchanges neither
            normals = lsh.planes(width, **parameters)
            rows = lsh.numbered(rows, normals)
        rows.write.mode("overwrite").parquet(f"{path}/vectors")
        have = spark.read.parquet(f"{path}/vectors")
        n = have.count()
        tables, arrays, told = {}, {}, {}
        if kind == "ivfpq":
            model = ivf.IvfPq.fit(have, parameters.get("lists"), n_total=n, **{k: v for k, v in parameters.items() if k in ("parts", "bits")})
            tables, arrays = {"cells": model.cells(have)}, model.arrays()
        elif kind == "lsh":
            arrays = {"normals": normals}
        elif kind == "forest":
            leaf = parameters.get("leaf", 40)
            model, leaves = forest.Forest.fit(have, parameters.get("trees") or trees_for(n), leaf).split(have, 4 * leaf)
            tables, arrays, told = model.tables(leaves), model.arrays(), {"trees": len(model.trees), "rounds": model.rounds}
        elif kind == "graph":
            tables = {"nodes": graph.build(have, **parameters)}
        base.save(tables, path, arrays, spark=spark, kind=kind, width=width, n=n, **told)
        return cls(spark, path)

    def add(self, vectors: DataFrame, **parameters) -> VectorIndex:
        """The index with further vectors; ids that it has already keep theirs. A graph's come in shards of their own until ``compact``."""
        have = self.spark.read.parquet(f"{self.path}/vectors")
        new = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), checked(F.col("embedding"), self.manifest["width"]).alias("embedding"))
        new = stored(new.join(have.select("id"), "id", "left_anti"))
        told = {**self.manifest, "n": self.manifest["n"] + new.count()}
        if self.kind == "graph":
            told.setdefault("first_late", self.tables["nodes"].agg(F.max("shard")).first()[0] + 1)
            rows = {"nodes": graph.later(new, self.tables["nodes"], **parameters)}
        else:
            rows = self._rows(new)
        for name, df in rows.items():
            df.write.mode("append").parquet(f"{self.path}/{self.manifest['tables'][name]}")
        if "held" in have.columns:
            new = lsh.numbered(new, self.arrays["normals"])
        new.write.mode("append").parquet(f"{self.path}/vectors")
        base.tell(self.spark, self.path, told)
        return VectorIndex(self.spark, self.path)

    def _forest(self) -> forest.Forest:
        return forest.Forest.of_arrays(self.arrays, self.manifest["trees"], self.tables.get("subtrees"), self.manifest["rounds"])

    def _rows(self, vectors: DataFrame) -> dict[str, DataFrame]:
        """What the tables of an index hold for vectors, by the model that it has."""
        if self.kind == "ivfpq":
            return {"cells": ivf.IvfPq.of_arrays(self.arrays).cells(vectors)}
        if "buckets" in self.tables:  # of an LSH index from when buckets were a table of their own
            return {"buckets": lsh.signatures(vectors, self.arrays["normals"])}
        if self.kind == "forest":
            return {"leaves": self._forest().leaves(vectors)}
        return {}

    def compact(self, **parameters) -> VectorIndex:
        """A graph whose later vectors have been inserted into the shards nearest to them. Until the manifest names the new nodes, the old ones hold."""
        if self.kind != "graph" or "first_late" not in self.manifest:
            return self
        told = {**self.manifest, "tables": {**self.manifest["tables"], "nodes": f"nodes-{uuid.uuid4().hex[:8]}"}}
        graph.compacted(self.tables["nodes"], told.pop("first_late"), **parameters).write.parquet(f"{self.path}/{told['tables']['nodes']}")
        base.tell(self.spark, self.path, told)
        return VectorIndex(self.spark, self.path)

    @property
    def kind(self) -> str:
        return self.manifest["kind"]

    def memory_mb(self) -> float:
        return dense.memory_mb(self.manifest["n"], self.manifest["width"])

    def search(self, queries: DataFrame, k: int = 10, **parameters) -> DataFrame:
        """q_id, id, score (cosine), rank; fewer than k rows where fewer are found. Queries of another width raise."""
        asked = queries.select("q_id", checked(F.col("embedding"), self.manifest["width"]).alias("embedding"))
        have = self.spark.read.parquet(f"{self.path}/vectors")
        if self.kind == "flat":
            return dense.exact_topk(asked, have, k, **parameters)
        if self.kind == "ivfpq":
            return ivf.IvfPq.of_arrays(self.arrays).search(asked, have, self.tables["cells"], k, **parameters)
        if "buckets" in self.tables:
            return lsh.search(asked, have, self.tables["buckets"], self.arrays["normals"], k, **parameters)
        if self.kind == "lsh":
            return lsh.search_numbered(asked, have, self.arrays["normals"], k, **parameters)
        if self.kind == "forest":
            return self._forest().search(asked, have, self.tables["leaves"], k, **parameters)
        return graph.search(asked, self.tables["nodes"], k, **parameters)


def timed_comparison(vectors: DataFrame, queries: DataFrame, kinds: dict[str, dict], k: int = 10) -> dict[str, tuple[DataFrame, float, float]]:
    """For every kind what it found, kept, and the seconds of building and searching. The index itself, and what it stored on the way, goes when it has been searched."""
    out = {}
    for kind, parameters in kinds.items():
        with made() as folders:
            index, build_s = base.clocked(lambda kind=kind, parameters=parameters: VectorIndex.build(vectors, kind, **parameters))
            found, search_s = base.timed(lambda index=index: index.search(queries, k))
        discard(*folders[:-1])  # the last is what was found
        out[kind] = (found, build_s, search_s)
    return out


def self_recall(index: VectorIndex, queries: DataFrame, exact: DataFrame, k: int = 10) -> float:
    """The share of the exact k nearest that the index finds."""
    found = index.search(queries, k).select("q_id", "id")
    n = exact.count()
    return found.join(exact.select("q_id", "id"), ["q_id", "id"], "left_semi").count() / n if n else float(np.nan)
