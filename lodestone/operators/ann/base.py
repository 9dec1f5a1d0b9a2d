"""What the indexes share: a bounded sample, exact scores of candidates, timing, and tables with a manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators.ranking import top
from lodestone.session import small, stored

#: Vectors on which centroids, codebooks and split planes are fitted, at most.
SAMPLE = 20_000

_SCORES = {
    "cosine": lambda a, b: V.cosine(a, b),
    "dot": lambda a, b: V.dot(a, b),
    "euclidean": lambda a, b: -V.euclidean(a, b),
    "manhattan": lambda a, b: -V.manhattan(a, b),
}


def sample(vectors: DataFrame, n: int | None = None, seed: int = 42) -> np.ndarray:
    """The first n vectors, SAMPLE where it isn't given, by a hash of their id, as a matrix on the driver."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed))).limit(n or SAMPLE).select("embedding").collect()
    return np.array([r[0] for r in rows], np.float64)


def ranked(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """q_id, id, score, rank: the candidates (q_id, id) by exact score.

    Candidates are exchanged once, by id, where they are made distinct and meet their vectors. Queries that are counted to be
    few are sent to them, so no vector is exchanged once for each of its pairs.
    """
    if metric not in _SCORES:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(_SCORES)}")
    asked = small(queries.select("q_id", F.col("embedding").alias("q_vector")))
    pairs = candidates.select("q_id", "id").repartition("id").distinct().join(vectors.select("id", "embedding"), "id").join(asked, "q_id")
    return top(pairs.select("q_id", "id", _SCORES[metric](F.col("q_vector"), F.col("embedding")).alias("score")), k)


def clocked(action: Callable):
    """The result and the seconds that it took, of what is not lazy."""
    began = time.perf_counter()
    return action(), time.perf_counter() - began


def timed(action: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """The result, stored, and the seconds that it took: plans are lazy, so only writing forces them."""
    return clocked(lambda: stored(action()))


def save(tables: dict[str, DataFrame], path: str, arrays: dict[str, np.ndarray] | None = None, spark: SparkSession | None = None, **parameters) -> None:
    """Tables, the arrays of a fitted model, and a manifest of parameters; the last is written last."""
    spark = spark or next(iter(tables.values())).sparkSession
    rows = [(name, list(a.shape), a.dtype.str, np.ascontiguousarray(a).tobytes()) for name, a in (arrays or {}).items()]
    model = spark.createDataFrame(rows, "name string, shape array<bigint>, kind string, data binary").coalesce(1)
    for name, df in {**tables, "model": model}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    tell(spark, path, {"tables": {name: name for name in sorted(tables)}, **parameters})


def tell(spark: SparkSession, path: str, manifest: dict) -> None:
    """Writes the manifest, which says what each table's folder is: a table that is replaced lies in a new one."""
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def arrays_of(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays that were saved; their sizes are those of a model, not of the data."""
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in manifest["tables"].items()}, manifest
