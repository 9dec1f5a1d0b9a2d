"""A text encoder learnt from a corpus: words by the company they keep.

1. Vocabulary: the most frequent words that stand in the corpus often enough.
2. Pairs of such words within a window, counted over whole texts; a task adds up its own before they are exchanged.
3. Cells: positive pointwise mutual information, ln(n(w, c) N / (n(w) n(c))), of a symmetric matrix over the vocabulary.
4. Factors: its greatest eigenvalues by randomised subspace iteration. A product with the matrix is one pass over the
   stored cells, which lie by row; what goes to the executors and comes back is a row of factors for every word.
5. A text is the sum of its words' vectors, rare words the heavier, less what all texts have in common, of unit length.
   A word beyond the vocabulary, of which nothing was learnt, has signs by its hash, and weighs as much as the rarest.

What the driver holds is bounded by VOCABULARY and the width, whatever the corpus. Nulls and texts without a word are the
zero vector. Repeated rows are counted as often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.ann import base
from lodestone.session import importable, stored

#: Words that are known, at most; how often each must stand in the corpus; words on either side that count as company.
VOCABULARY, LEAST, WINDOW = 30_000, 2, 4
#: Words of a text part that are paired at once, and pairs that a task adds up before it passes them on.
PART, HELD = 200_000, 2_000_000
#: A word of share p in the corpus weighs RARE / (RARE + p).
RARE = 1e-5
#: Factors beyond the width that the iteration carries along, and its rounds.
BEYOND, ROUNDS = 16, 4

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def vocabulary(docs: DataFrame, most: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """term, n: the most frequent words of docs (text), ties by the word."""
    words = docs.select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def _company(line: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as one number) and counts of the known words of a line that stand at most ``window`` apart; -1 is no known word."""
    keys = []
    for off in range(1, window + 1):
        a, b = line[:-off], line[off:]
        both = (a >= 0) & (b >= 0)
        keys += [a[both] * size + b[both], b[both] * size + a[both]]
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pairs(docs: DataFrame, words: list[str], window: int = WINDOW) -> DataFrame:
    """row, col, n: how often word number ``col`` stands at most ``window`` words from ``row``, over whole texts."""
    importable(docs.sparkSession)
    size, known = max(1, len(words)), pa.array(words, pa.string())

    def added(found: list) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place.ravel(), counts, len(keys)).astype(np.int64)

    def told(found: list) -> Iterator[pa.RecordBatch]:
        keys, counts = added(found)
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // size), pa.array(k % size), pa.array(counts[at : at + 100_000])], ["row", "col", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            column = batch["words"]
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.index_in(column.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            # A gap as wide as the window stands behind each text, so that no pair crosses it.
            line = np.full(len(flat) + window * len(sizes), -1, np.int64)
            line[np.arange(len(flat)) + window * np.repeat(np.arange(len(sizes)), sizes)] = flat
            for at in range(0, len(line), PART):
                # A part carries on for a window; the pairs that lie within that alone are the next part's.
                part, over = line[at : at + PART + window], line[at + PART : at + PART + window]
                keys, counts = _company(part, size, window)
                again, less = _company(over, size, window)
                np.subtract.at(counts, np.searchsorted(keys, again), less)
                found.append((keys, counts))
                held += len(keys)
                if held > HELD:
                    found = [added(found)]
                    held = len(found[0][0])
                    if 2 * held > HELD:
                        yield from told(found)
                        found, held = [], 0
        if found:
            yield from told(found)

    split = docs.where("text IS NOT NULL").select(tokens(F.col("text")).alias("words"))
    each = split.mapInArrow(run, "row bigint, col bigint, n bigint").where("n > 0")
    return each.groupBy("row", "col").agg(F.sum("n").alias("n"))


def cells(counted: DataFrame) -> DataFrame:
    """row, col, value: of the pairs that stand together more often than by chance."""
    each = counted.groupBy("row").agg(F.sum("n").alias("all"))  # as many rows as words, which are bounded
    total = F.broadcast(each.agg(F.sum("all").alias("total")))
    sides = counted.join(F.broadcast(each.withColumnRenamed("all", "row_n")), "row")
    sides = sides.join(F.broadcast(each.select(F.col("row").alias("col"), F.col("all").alias("col_n"))), "col").crossJoin(total)
    value = F.log(F.col("n").cast("double") * F.col("total") / (F.col("row_n").cast("double") * F.col("col_n")))
    return sides.select("row", "col", value.alias("value")).where("value > 0")


def product(matrix: DataFrame, factors: np.ndarray) -> np.ndarray:
    """The matrix (row, col, value) times the factors, a row for every word. A task gives one line for each of its rows and batches."""
    context = matrix.sparkSession.sparkContext
    sent, width = context.broadcast(factors.astype(np.float32)), factors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col, value = (batch[c].to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
            if len(row):
                order = np.argsort(row, kind="stable")
                row, col, value = row[order], col[order], value[order]
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sums = np.add.reduceat(sent.value[col].astype(np.float64) * value[:, None], starts)
                yield pa.RecordBatch.from_arrays([pa.array(row[starts]), pa.array(list(sums), pa.list_(pa.float64()))], ["row", "line"])

    out = np.zeros(factors.shape)
    lines = matrix.mapInArrow(run, "row bigint, line array<double>")
    sums = lines.groupBy("row").agg(F.array(*[F.sum(F.get("line", F.lit(i))) for i in range(width)]).alias("line")).toArrow()
    if sums.num_rows:
        out[sums["row"].to_numpy()] = sums["line"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    sent.destroy()
    return out


def eigen(matrix: DataFrame, size: int, width: int, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of greatest size of a symmetric matrix, and their vectors as columns."""
    wide = min(size, width + BEYOND)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(matrix, q))[0]
    small = q.T @ product(matrix, q)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:width]
    return values[first], q @ turned[:, first]


@dataclass
class CorpusEmbedder:
    """Encodes texts by the vectors of their words. It is as large as its vocabulary, and goes to the executors with the plan."""

    words: list[str]
    vectors: np.ndarray  # centred and weighted

    def __post_init__(self):
        self.dim = self.vectors.shape[1]
        self._place = {w: i for i, w in enumerate(self.words)}

    @classmethod
    def fit(cls, docs: DataFrame, dim: int = 64, most: int = VOCABULARY, least: int = LEAST, window: int = WINDOW, company: bool = True) -> CorpusEmbedder:
        """From docs (text). Without ``company`` only the weights are learnt, and every word has the signs of its hash."""
        found = vocabulary(docs, most, least).collect()
        words, n = [r["term"] for r in found], np.array([r["n"] for r in found], np.float64)
        if not words:
            return cls([], np.zeros((0, dim), np.float32))
        share = n / n.sum()
        weight = RARE / (RARE + share)
        if not company:
            signs = cls([], np.zeros((0, dim), np.float32))._signs
            return cls(words, (np.array([signs(w) for w in words]) * weight[:, None]).astype(np.float32))
        matrix = stored(cells(stored(pairs(docs, words, window))).repartition("row"))
        values, axes = eigen(matrix, len(words), min(dim, len(words)))
        vectors = np.zeros((len(words), dim))
        vectors[:, : len(values)] = axes  # every axis weighs the same, whatever its eigenvalue
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-10
        common = (share * weight) @ vectors / (share @ weight)
        return cls(words, ((vectors - common) * weight[:, None]).astype(np.float32))

    def encode_texts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(m.group() for m in _WORD.finditer((text or "").lower())).items():
                at = self._place.get(word)
                row += n * (self._signs(word) if at is None else self.vectors[at])
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-10)).astype(np.float32)

    def _signs(self, word: str) -> np.ndarray:
        digests = [xxhash.xxh64_intdigest(word, i).to_bytes(8, "little") for i in range(-(-self.dim // 64))]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8))[: self.dim]
        return (2.0 * bits - 1) / np.sqrt(self.dim)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"place": pa.array(range(len(self.words)), pa.int64()), "term": pa.array(self.words, pa.string()), "vector": pa.array(list(self.vectors), pa.list_(pa.float32()))})
        base.save({"words": spark.createDataFrame(rows)}, path, spark=spark, kind="words", dim=self.dim)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusEmbedder:
        tables, manifest = base.load(spark, path)
        rows = tables["words"].orderBy("place").collect()
        return cls([r["term"] for r in rows], np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), manifest["dim"]))
