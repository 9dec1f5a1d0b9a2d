"""Operator 11: resampling towards a target distribution, by hashed n-grams whose strings are never made.

A feature is a run of one to ``max_n`` words joined by blanks, its bucket the CRC-32 of its bytes modulo the buckets. Each
distinct word's CRC is computed once. That of a longer run follows from its parts: the CRC of a joined string is the CRC
of the first part, multiplied over GF(2) by the matrix that shifts by the length of the second, plus the CRC of the
second. The matrices for powers of two are tables of bytes, so whole arrays are shifted at once.

Documents and target texts are counted by bucket; a bucket's gain is the log ratio of its smoothed shares in thousandths,
a document's weight the floored mean of its features' gains. Gumbel noise from a hash of the id turns the highest scores
into a draw without replacement in proportion to the weights' exponentials.

What reaches the driver is bounded: a count for each bucket, and a count for each integer score, of which there are at
most some 170,000 (weights lie within 70,000 of zero for any counts below 10^15, noise between -3,131 and 22,875).

Null texts have no words: no features, weight 0, never drawn. Null ids hash as empty text and come last among equal
scores. Rows that repeat an id have the same noise and are drawn by themselves, so they take up a rank each. Without
documents, or without target texts, the result is that of counts of zero. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE, give_back, map_rows, stored, texts_of
from lodestone.session import importable

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distinct words whose CRCs a task keeps; beyond it the cache starts anew.
CACHE = 500_000
#: A byte of a word stands for itself or, from A to Z, for its small letter; any other byte below 128 parts words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _squared(columns: list[int]) -> list[int]:
    return [_times(columns, c) for c in columns]


def _times(columns: list[int], vector: int) -> int:
    out = 0
    for c in columns:
        if vector & 1:
            out ^= c
        vector >>= 1
    return out


def shift_tables(bits: int = 32) -> np.ndarray:
    """(bits, 4, 256): for each power of two of bytes, what each byte of a CRC becomes when so many zero bytes follow."""
    columns = [POLYNOMIAL, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        columns = _squared(columns)
    out = np.zeros((bits, 4, 256), np.uint32)
    for k in range(bits):
        for j in range(4):
            out[k, j] = [_times(columns, b << 8 * j) for b in range(256)]
        columns = _squared(columns)
    return out


class Crcs(dict):
    """CRCs of distinct words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = zlib.crc32(word)
        return found


class Features:
    """CRCs of all runs of words of several texts at once."""

    def __init__(self, max_n: int):
        if max_n < 1:
            raise ValueError("a run has at least one word")
        self.max_n, self.crcs = max_n, Crcs()
        self.tables = shift_tables() if max_n > 1 else None

    def shifted(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The part of a joined string's CRC that comes from its first part, given how long the second is."""
        out = crcs.copy()
        for k in range(int(lengths.max(initial=0)).bit_length()):
            at = np.flatnonzero(lengths >> k & 1)
            x, t = out[at], self.tables[k]
            out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return out

    def of(self, texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; CRC and text of each feature."""
        words: list[bytes] = []
        sizes = []
        for text in texts:
            found = (text or "").encode().translate(WORD_BYTES).split()
            sizes.append(len(found))
            words += found
        crcs = np.fromiter(map(self.crcs.__getitem__, words), np.uint32, len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if self.max_n == 1:
            return np.array(sizes, np.int64), crcs, owner
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        after_blank = self.shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), lengths) ^ crcs
        runs, owners, now = [crcs], [owner], crcs
        for n in range(1, self.max_n):
            now = self.shifted(now[:-1], lengths[n:] + 1) ^ after_blank[n:] if len(now) > 1 else now[:0]
            whole = owner[: len(now)] == owner[n : n + len(now)]
            runs.append(now[whole])
            owners.append(owner[: len(now)][whole])
        return np.array(sizes, np.int64), np.concatenate(runs), np.concatenate(owners)


def bucket_counts(df: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of the whole table by bucket. Each task adds up its own, so a row goes out for each of its buckets."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(max_n), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                total += np.bincount(features.of(t.as_py() for t in batch["text"].slice(at, SLICE))[1] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        del features
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the key's SHA-256."""
    return math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))


def weigh(df: DataFrame, gain: np.ndarray, seed: int, max_n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score of every text."""
    rows = texts_of(df, id_col, text_col).withColumn("key", F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))

    def start():
        features, buckets = Features(max_n), len(gain)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, crcs, owner = features.of(t.as_py() for t in batch["text"])
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, weights=gain[crcs % buckets], minlength=batch.num_rows).astype(np.int64)  # whole numbers far below 2^53
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(k) for k in batch["key"].to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([batch["id"], *(pa.array(x, pa.int64()) for x in (words, n, weight, score))], ["id", "n_words", "n_features", "weight", "score"])

        return apply

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint")


def draw(scored: DataFrame, percent: int, able: Column) -> DataFrame:
    """The rows with their rank among the highest scores, for floor(percent / 100) of those that are ``able``; null for all others.

    ``scored`` is read twice. A rank is the number of higher scores, which a count for each score tells, and the place
    among equal ones. Only rows that may be drawn are exchanged, by score; noise spreads the rows of any one weight, so
    that at most one in 2,700 of them has the same score.
    """
    counts = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    above, at = [], 0
    for score, n in counts:
        if at >= wanted:
            break
        above.append((score, at))
        at += n
    if not above:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    may = able & (F.col("score") >= above[-1][0])
    higher = scored.sparkSession.createDataFrame(above, "score bigint, higher bigint")  # a row for each score that is drawn
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight"))
    drawn = scored.where(may).withColumn("place", place).join(F.broadcast(higher), "score")
    rank = F.col("higher") + F.col("place")
    drawn = drawn.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(scored.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, max_n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, text_col, max_n, buckets))
    return draw(stored(weigh(docs, gain, seed, max_n, id_col, text_col)), percent, F.col("n_words") >= least_words)
