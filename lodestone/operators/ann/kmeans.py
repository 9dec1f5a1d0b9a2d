"""Lloyd's rounds over whole tables of vectors, and lists in two levels whose number follows the table.

A round compares blocks of vectors with all centres by matrix products. A task adds up what it saw and sends a row for
each centre; sums meet by centre, and what reaches the driver is the centres themselves, whose size a parameter bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import lists_for
from lodestone.operators.dense import matrix
from lodestone.session import importable, stored

#: Numbers in all centres, at most, and vectors compared at once.
CENTRE_NUMBERS, BLOCK = 8_000_000, 1024
#: Lists up to which one level is enough.
FLAT = 400


def lists_of(n: int, width: int = 0) -> int:
    """Lists for n vectors: beyond 160,000 vectors as many as their root, as far as the centres fit."""
    wanted = max(FLAT, isqrt(n)) if n > FLAT**2 else lists_for(n)
    return min(wanted, max(FLAT, CENTRE_NUMBERS // width)) if width else wanted


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :])


def scaled(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)


@dataclass
class Lists:
    """Centres of lists. With two levels, list i belongs to group i // (lists a group); groups have centres of their own."""

    centres: np.ndarray
    groups: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.centres)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's list; of equal distances the smaller number."""
        list_, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), BLOCK):
            some = x[at : at + BLOCK]
            if self.groups is None:
                every = distances(some, self.centres)
                best = every.argmin(1)
                list_[at : at + BLOCK], far[at : at + BLOCK] = best, every[np.arange(len(some)), best]
                continue
            group, each = distances(some, self.groups).argmin(1), len(self.centres) // len(self.groups)
            for g in np.unique(group).tolist():
                rows = np.flatnonzero(group == g)
                every = distances(some[rows], self.centres[g * each : (g + 1) * each])
                best = every.argmin(1)
                list_[at + rows], far[at + rows] = g * each + best, every[np.arange(len(rows)), best]
        return list_, far

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector; with two levels, of the nearest groups that hold four times as many lists, or n groups."""
        if self.groups is None:
            return np.argsort(distances(x, self.centres), axis=1, kind="stable")[:, :n]
        each = len(self.centres) // len(self.groups)
        wide = min(len(self.groups), max(n, ceil(4 * n / each)))
        out = np.zeros((len(x), n), np.int64)
        for i, order in enumerate(np.argsort(distances(x, self.groups), axis=1, kind="stable")[:, :wide]):
            numbers = (order[:, None] * each + np.arange(each)).ravel()
            out[i] = numbers[np.argsort(distances(x[i : i + 1], self.centres[numbers])[0], kind="stable")[:n]]
        return out


def first_centres(vectors: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """The k vectors whose ids hash lowest by md5, so that any engine can choose them."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(k).select("embedding").collect()
    return np.array([r[0] for r in rows], np.float64)


def assigned(vectors: DataFrame, lists: Lists, unit: bool = False, keep: bool = False) -> DataFrame:
    """id, list, far: the nearest list of every vector and its squared distance; the vector too if ``keep``."""
    importable(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            x = matrix(batch["v"], lists.centres.shape[1])
            number, far = lists.nearest(scaled(x) if unit else x)
            kept = [batch["v"]] if keep else []
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(number, pa.int32()), pa.array(far), *kept], ["id", "list", "far", "embedding"][: 3 + keep])

    kind = f", embedding {vectors.schema['embedding'].dataType.simpleString()}" if keep else ""
    return vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, f"id bigint, list int, far double{kind}")


def means(vectors: DataFrame, lists: Lists, unit: bool = False) -> np.ndarray:
    """The mean of each list's vectors; a list without vectors keeps its centre."""
    importable(vectors.sparkSession)
    k, width = lists.centres.shape

    def run(batches):
        count, total = np.zeros(k), np.zeros((k, width))
        for batch in batches:
            x = matrix(batch["v"], width)
            x = scaled(x) if unit else x
            near = lists.nearest(x)[0]
            order = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0]) if len(near) else np.zeros(0, int)
            if len(first):
                total[near[order][first]] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count)
        rows = np.concatenate([total[some], count[some, None]], 1)  # the number of vectors behind the components
        at = pa.array(np.arange(len(some) + 1) * (width + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(at, pa.array(rows.ravel()))], ["list", "total"])

    sums = vectors.where("embedding IS NOT NULL").select(F.col("embedding").alias("v")).mapInArrow(run, "list int, total array<double>")
    out = lists.centres.copy()
    together = sums.select("list", F.posexplode("total").alias("at", "x")).groupBy("list", "at").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in together.collect():  # the centres' size
        found.setdefault(r["list"], np.zeros(width + 1))[r["at"]] = r["x"]
    for number, total in found.items():
        out[number] = total[:-1] / total[-1]
    return out


def lloyd(vectors: DataFrame, centres: np.ndarray, rounds: int, unit: bool = False) -> Lists:
    """Centres after so many rounds over all vectors."""
    lists = Lists(centres)
    for _ in range(rounds):
        lists = Lists(means(vectors, lists, unit))
    return lists


def two_levels(vectors: DataFrame, k: int, rounds: int = 4, unit: bool = False, seed: int = 42) -> Lists:
    """At least k lists: the root of k groups by Lloyd's rounds, and as many lists within each, moved by rounds over all vectors.

    A group's first lists are those of its vectors that hash lowest. Only these and the sums move; a group that has fewer
    vectors than lists repeats its own, and the repeated lists stay empty.
    """
    g = ceil(k**0.5)
    first = first_centres(vectors, g, seed)
    groups = lloyd(vectors, scaled(first) if unit else first, rounds, unit).centres
    each = ceil(k / len(groups))
    of = stored(assigned(vectors, Lists(groups), unit).select("id", "list"))
    order = Window.partitionBy("list").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed + 1}"))), "id")
    heads = of.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    rows = heads.join(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "id").select("list", "place", "embedding").collect()  # as many as lists
    centres = np.repeat(groups, each, axis=0)
    have = np.zeros(len(groups), int)
    for r in sorted(rows, key=lambda r: (r["list"], r["place"])):
        x = np.array(r["embedding"], np.float64)
        centres[r["list"] * each + r["place"] - 1] = scaled(x[None])[0] if unit else x
        have[r["list"]] = r["place"]
    for i in np.flatnonzero(have):
        centres[i * each + have[i] : (i + 1) * each] = centres[i * each]
    lists = Lists(centres, groups)
    for _ in range(rounds):
        lists = Lists(means(vectors, lists, unit), groups)
    return lists
