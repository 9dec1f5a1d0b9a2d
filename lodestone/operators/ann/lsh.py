"""Random-hyperplane hashing: buckets(table_id, signature, id), searched by equality in any table; or their numbers beside the vectors.

A query may also ask for signatures with one bit turned, those first whose planes are nearest to it, so that longer
signatures find as much: their number of bits follows the table, a bucket's size and a query's candidates don't.
"""

from __future__ import annotations

import hashlib
from math import ceil, cos, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators import dense
from lodestone.operators.ann import base
from lodestone.operators.ann.base import ranked
from lodestone.operators.dense import matrix
from lodestone.operators.ranking import top
from lodestone.session import importable

#: A block's meetings are looked up pair by pair up to one in so many of all its pairs; pairs whose vectors are compared at once.
MANY, PAIRS = 32, 65_536


def planes(dim: int, tables: int = DEFAULT.lsh_tables, bits: int = DEFAULT.lsh_bits, seed: int = 42) -> np.ndarray:
    """(tables, bits, dim) Gaussian coordinates, drawn from md5 by the polar form, so that any engine can draw them too."""

    def draw(t: int, b: int, d: int) -> float:
        digest = hashlib.md5(f"{t}:{b}:{d}:{seed}".encode()).hexdigest()  # noqa: S324
        u, v = ((int(digest[i : i + 8], 16) + 0.5) / 4294967296.0 for i in (0, 8))
        return sqrt(-2 * log(u)) * cos(2 * pi * v)

    return np.array([[[draw(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)])


def bits_for(n: int, each: int = 64) -> int:
    """Bits of a signature, so that a bucket has some ``each`` of n vectors where the planes cut them evenly."""
    return max(4, ceil(log2(max(n, 1) / each)) if n > each else 4)


def signatures(vectors: DataFrame, normals: np.ndarray, key: str = "id", flips: int = 0) -> DataFrame:
    """key, table_id, signature: a bit is 1 where the projection is above 0; also with each of the ``flips`` bits turned whose planes are nearest."""
    importable(vectors.sparkSession)
    tables, bits, dim = normals.shape
    flat = normals.reshape(tables * bits, dim)
    flips = min(flips, bits)

    def run(batches):
        for batch in batches:
            sides = (matrix(batch["v"], dim) @ flat.T).reshape(-1, tables, bits)
            signs = np.repeat((sides > 0)[:, :, None], flips + 1, axis=2)  # vectors, tables, probes, bits
            near = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :flips]
            turned = np.take_along_axis(~(sides > 0), near, axis=2)
            for i in range(flips):
                np.put_along_axis(signs[:, :, i + 1], near[:, :, i : i + 1], turned[:, :, i : i + 1], axis=2)
            text = (signs.reshape(-1, bits) + np.uint8(48)).view(f"S{bits}").ravel()
            each = tables * (flips + 1)
            numbers = np.tile(np.repeat(np.arange(tables), flips + 1), len(sides))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["key"].to_numpy(), each)), pa.array(numbers, pa.int32()), pa.array(text).cast(pa.string())], [key, "table_id", "signature"])

    return vectors.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.col("embedding").alias("v")).mapInArrow(run, f"{key} bigint, table_id int, signature string")


def save(path: str, buckets: DataFrame, normals: np.ndarray) -> None:
    base.save({"buckets": buckets}, path, {"normals": normals}, kind="lsh")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The buckets and the planes, ready to be searched."""
    return base.load(spark, path)[0]["buckets"], base.arrays_of(spark, path)["normals"]


def numbered(vectors: DataFrame, normals: np.ndarray) -> DataFrame:
    """id, embedding, held: vectors beside their buckets' numbers, one of each table, so that a search needs no join to tell them."""
    importable(vectors.sparkSession)
    tables, bits, dim = _fits(normals)
    flat = normals.reshape(tables * bits, dim)

    def run(batches):
        for batch in batches:
            own = _numbers((matrix(batch["embedding"], dim) @ flat.T).reshape(-1, tables, bits), 0).ravel()
            held = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(own))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["embedding"], held], ["id", "embedding", "held"])

    kept = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    return kept.mapInArrow(run, f"id bigint, embedding {kept.schema['embedding'].dataType.simpleString()}, held array<bigint>")


def search(queries: DataFrame, vectors: DataFrame, buckets: DataFrame, normals: np.ndarray, k: int, metric: str = "cosine", fallback: int = 10, flips: int = 0) -> DataFrame:
    """q_id, id, score, rank. A query that meets no bucket gets a sample of its own of about ``fallback`` * k vectors instead.

    Pairs that share a bucket are never rows: each block of vectors, with the buckets that they are in, is looked up by the
    blocks of queries, and only k rows a query and task leave it. What is exchanged is each vector once; nothing of them
    where they are ``numbered`` (``search_numbered``).
    """
    tables, bits, _ = _fits(normals)
    number = F.conv("signature", 2, 10).cast("long")
    held = buckets.groupBy("id").agg(*[F.max(F.when(F.col("table_id") == t, number)).alias(f"t{t}") for t in range(tables)])
    own = vectors.join(held.select("id", F.array(*[F.coalesce(f"t{t}", F.lit(-1).cast("long")) for t in range(tables)]).alias("held")), "id")
    return _filled(queries, vectors, own, buckets.select("table_id", "signature"), normals, k, metric, fallback, flips)


def search_numbered(queries: DataFrame, vectors: DataFrame, normals: np.ndarray, k: int, metric: str = "cosine", fallback: int = 10, flips: int = 0) -> DataFrame:
    """As ``search``, among vectors that are ``numbered``."""
    tables, bits, _ = _fits(normals)
    vectors = vectors.where("id IS NOT NULL")
    buckets = vectors.select(F.posexplode("held").alias("table_id", "number")).select("table_id", F.lpad(F.bin("number"), bits, "0").alias("signature"))
    return _filled(queries, vectors.select("id", "embedding"), vectors, buckets, normals, k, metric, fallback, flips)


def _fits(normals: np.ndarray) -> tuple[int, int, int]:
    if normals.shape[1] > 63:
        raise ValueError(f"signatures of {normals.shape[1]} bits, 63 at most")
    return normals.shape


def _filled(queries: DataFrame, vectors: DataFrame, own: DataFrame, buckets: DataFrame, normals: np.ndarray, k: int, metric: str, fallback: int, flips: int) -> DataFrame:
    """The best of the vectors beside their numbers (``own``), and the samples of queries whose buckets aren't among those given."""
    found = top(_scored(queries, vectors, own, normals, k, metric, flips), k)
    known = signatures(queries, normals, "q_id", flips).join(buckets.distinct(), ["table_id", "signature"], "left_semi")
    lonely = queries.join(known.select("q_id").distinct(), "q_id", "left_anti")
    if lonely.isEmpty():
        return found
    # Vectors are dealt by a hash into sets of that size, and a query's own hash picks one of them.
    sets = F.lit(max(1, vectors.count() // (fallback * k)))
    dealt = lambda df, key: df.select(key, F.pmod(F.xxhash64(key, F.lit(42)), sets).alias("dealt"))
    drawn = dealt(lonely, "q_id").join(dealt(vectors, "id"), "dealt").select("q_id", "id")
    return found.unionByName(ranked(queries, drawn, vectors, k, metric))


def _scored(queries: DataFrame, vectors: DataFrame, own: DataFrame, normals: np.ndarray, k: int, metric: str, flips: int) -> DataFrame:
    """q_id, id, score: of each task's vectors every query's k best of those that share a bucket with it or one of its probes."""
    dense.known(metric)
    tables, bits, dim = normals.shape
    flat = normals.reshape(tables * bits, dim)

    def run(batches):
        kept = {}
        for asked, q, known, m, codes in dense.opened(batches):
            block = (asked.tobytes(), q.tobytes())
            if block not in kept:
                if (sum(len(b.asked) for b in kept.values()) + len(asked)) * k > dense.TASK_ROWS:
                    yield from (b.rows() for b in kept.values())
                    kept.clear()
                kept[block] = _Best(asked, q, _numbers((q @ flat.T).reshape(-1, tables, bits), flips), k, metric)
            kept[block].meet(known, m, np.frombuffer(codes, np.int64).reshape(len(known), tables))
        yield from (b.rows() for b in kept.values())

    return dense.met(queries, own, "held", k=k, width=dim, of=vectors).mapInArrow(run, dense.SCORED)


class _Best:
    """The k best for each of a block's queries among the vectors met so far, by score at nine places and then by id; NaN is greatest, as Spark has it."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int, metric: str):
        self.asked, self.q, self.probes, self.k, self.metric = asked, q, probes, k, metric
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def rows(self) -> pa.RecordBatch:
        return dense.scored(self.asked[self.row], self.id, self.score)

    def meet(self, known: np.ndarray, m: np.ndarray, have: np.ndarray) -> None:
        n = np.bincount(self.row, minlength=len(self.asked))
        full = n == self.k
        settled = 2 * full.sum() >= len(full)
        row, at = _shared(self.probes, have, not settled)
        if row is not None:
            s = np.concatenate([np.zeros(0), *(dense.paired(self.q[row[i : i + PAIRS]], m[at[i : i + PAIRS]], self.metric) for i in range(0, len(row), PAIRS))])
        else:  # so many that the whole block is compared at once
            s = dense.similarity(self.q, m, self.metric)
            row, at = self._better(s, known, have, full, np.cumsum(n) - 1) if settled else dense.best(s, known, self.k, at)
            s = s[row, at]
        row, ids, s = np.concatenate([self.row, row]), np.concatenate([self.id, known[at]]), np.concatenate([self.score, s])
        order = np.lexsort((ids, -_places(s), row))
        row, ids, s = row[order], ids[order], s[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.id, self.score = row[first], ids[first], s[first]

    def _better(self, s: np.ndarray, known: np.ndarray, have: np.ndarray, full: np.ndarray, last: np.ndarray):
        """Rows and columns of the pairs that share a bucket among those that come before their query's k-th so far; few are left to be looked up."""
        least, tie = np.full(len(full), -np.inf), np.full(len(full), np.iinfo(np.int64).max)
        least[full], tie[full] = _places(self.score[last[full]]), self.id[last[full]]
        bound = least - np.where(np.isfinite(least), 1e-9 + 1e-12 * np.abs(least), 0)
        row, at = np.nonzero(~(s < bound[:, None]))
        got = _places(s[row, at])
        before = (got > least[row]) | ((got == least[row]) & (known[at] < tie[row]))
        row, at = row[before], at[before]
        share = [np.zeros(0, bool), *((self.probes[row[i : i + PAIRS]] == have[at[i : i + PAIRS], :, None]).any(axis=(1, 2)) for i in range(0, len(row), PAIRS))]
        share = np.concatenate(share)
        return row[share], at[share]


def _places(s: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(s), np.inf, np.round(s, 9))


def _numbers(sides: np.ndarray, flips: int) -> np.ndarray:
    """(vectors, tables, probes): signatures as binary numbers, the own one first, then with each of the nearest bits turned."""
    value = 1 << np.arange(sides.shape[2], dtype=np.int64)[::-1]
    near = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :flips]
    own = ((sides > 0) @ value)[:, :, None]
    return np.concatenate([own, own ^ value[near]], axis=2)


def _shared(probes: np.ndarray, have: np.ndarray, tabled: bool = True):
    """Rows and columns of the pairs that share a bucket, each once; or None and a table of them, if that is wanted, where they are more than a few in a hundred."""
    lines, meetings = [], 0
    for t in range(have.shape[1]):
        order = np.argsort(have[:, t], kind="stable")
        codes = have[order, t]
        low, high = np.searchsorted(codes, probes[:, t], "left"), np.searchsorted(codes, probes[:, t], "right")
        lines.append((order, low, high - low))
        meetings += int((high - low).sum())
    if meetings * MANY > len(probes) * len(have):
        if not tabled:
            return None, None
        kind = np.min_scalar_type(-1 - int(max(probes.max(), have.max())))
        asked, held, table = probes.astype(kind), have.astype(kind), np.zeros((len(probes), len(have)), bool)
        for t in range(have.shape[1]):
            for p in range(probes.shape[2]):
                table |= asked[:, t, p, None] == held[None, :, t]
        return None, table
    pairs = [np.zeros(0, np.int64)]
    for order, low, n in lines:
        low, n = low.ravel(), n.ravel()
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pairs.append(row // probes.shape[2] * len(have) + order[place])
    return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(have)))


def candidates(queries: DataFrame, buckets: DataFrame, normals: np.ndarray, flips: int = 0) -> DataFrame:
    """q_id, id: what shares a bucket with a query or with one of its probes in any table."""
    return signatures(queries, normals, "q_id", flips).join(buckets, ["table_id", "signature"]).select("q_id", "id").distinct()
