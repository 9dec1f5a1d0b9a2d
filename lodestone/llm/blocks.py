"""Documents in blocks of bounded size, each with its own numbering of words.

A block is one row: the ids and lengths of its documents, its distinct words, and every word of its texts as a number
within the block. Exchanges with the rest of the corpus then carry one entry for each distinct thing in a block, and an
answer is bits or counts in the order that was asked. The table of blocks lies in the shared folder, so block numbers
hold whatever executors are lost, and is bucketed by them, so answers go to the blocks and blocks are never exchanged.

Words are runs of bytes other than blank and \\t to \\r. Nulls are texts without words. A document is never split: a
very long one is a block by itself.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.session import importable

#: A block closes when it has so many words or bytes.
BLOCK_WORDS, BLOCK_BYTES = 1_000_000, 8_000_000
#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1

SCHEMA = "block bigint, ids array<bigint>, flags array<boolean>, sizes array<int>, n_words bigint, words binary, codes binary"
NAMES = ["block", "ids", "flags", "sizes", "n_words", "words", "codes"]


def narrow(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, as few as they need, which compress well."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()


def widen(packed: bytes) -> np.ndarray:
    planes = packed[0]
    found = np.frombuffer(packed, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((found.shape[1], 4), np.uint8)
    out[:, :planes] = found.T
    return out.view("<u4").ravel()


class Block:
    """A row of the table, read back."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = row["ids"]
        self.flags = np.array([bool(x) for x in row["flags"]])
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = row["words"].split(b"\n") if row["words"] else []
        self.codes = widen(row["codes"]).astype(np.int64)
        self.starts = np.concatenate([[0], self.sizes.cumsum()])[:-1].astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def rows_of(batch: pa.RecordBatch):
    """Rows as dicts, one at a time: a row is megabytes."""
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _close(number: int, docs: list[tuple[int | None, bool, list[bytes]]]) -> pa.RecordBatch:
    docs.sort(key=lambda d: NO_ID if d[0] is None else d[0])
    numbers = defaultdict(count().__next__)
    codes = [np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)) for _, _, words in docs]
    sizes = list(map(len, codes))
    row = [number, [d[0] for d in docs], [d[1] for d in docs], sizes, sum(sizes), b"\n".join(numbers), narrow(np.concatenate(codes))]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], NAMES)


def parts(df: DataFrame) -> int:
    """Buckets of the table of blocks, and partitions of what is joined to it: as many as an exchange has."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None, lower: bool = False) -> DataFrame:
    """The stored table of blocks, bucketed by their numbers. ``flag`` is a truth of each document, kept with it; ``lower`` folds A-Z only."""
    importable(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"))

    def run(batches):
        part, made, docs, words, size = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            for number, text, mark in zip(batch["id"].to_pylist(), batch["text"], batch["flag"].to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                split = (raw.lower() if lower else raw).split()
                docs.append((number, mark, split))
                words, size = words + len(split), size + len(raw)
                if words >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield _close(part << 32 | made, docs)
                    made, docs, words, size = made + 1, [], 0, 0
        if docs:
            yield _close(part << 32 | made, docs)

    return stored(rows.mapInArrow(run, SCHEMA), "block", parts(df))


def digests(words: list[bytes]) -> np.ndarray:
    """(words, 2): 128 bits of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def buckets_for(entries: int, each: int = 500_000) -> int:
    """A power of two of buckets, so that one holds about so many entries."""
    return 1 << max(6, (max(1, entries) // each).bit_length())


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted 64-bit keys that are cut by their leading bits; empty ones are left out."""
    edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1))
    edges = [0, *edges.tolist(), len(keys)]
    return [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every block with the answers to it, in order of their buckets: at most as many as the block has distinct entries, which its size bounds.

    Only answers are exchanged: into the parts in which the blocks lie already.
    """
    told = answers.repartition(parts(blocks), "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    return blocks.join(told, "block", "left")
