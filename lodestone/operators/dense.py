"""Exact vector search: blocks of queries against blocks of vectors, each pair one matrix product in an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top
from lodestone.session import importable, is_small, stored

#: Vectors of a block, and queries up to which their blocks are sent to every executor.
QUERY_BLOCK, VECTOR_BLOCK, SENT_QUERIES = 1024, 4096, 10_000
METRICS = ("cosine", "dot", "euclidean", "manhattan")
#: Vectors of a block where all pairs are rows, and such rows at once.
PAIR_BLOCK, SLICE = 8192, 262_144
#: Queries of a task, and those times k, at most, where its vectors are dealt out for k rows a query; bytes of such a row.
TASK_QUERIES, TASK_ROWS, ROW_BYTES = 16_384, 2_000_000, 24
SCORED = "q_id bigint, id bigint, score double"


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles. All must have the same width, or the one that is given."""
    if not len(column):
        return np.zeros((0, width or 0))
    widths = pc.min_max(column.value_lengths()).as_py()
    if widths["min"] != widths["max"] or widths["min"] != (widths["min"] if width is None else width):
        raise ValueError(f"expected vectors of width {widths['min'] if width is None else width}, got {widths['min']} to {widths['max']}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer, whatever the metric."""
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"queries of width {a.shape[1]}, vectors of width {b.shape[1]}")
    if metric == "dot":
        return a @ b.T
    if metric == "cosine":
        return (a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-10)) @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-10)).T
    if metric == "euclidean":
        return -np.sqrt(np.maximum(0.0, np.stack([((row - b) ** 2).sum(1) for row in a])))
    if metric == "manhattan":
        return -np.stack([np.abs(row - b).sum(1) for row in a])
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def paired(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """As ``similarity``, of each row of a and the row of b in its place."""
    if metric == "dot":
        return np.einsum("ij,ij->i", a, b)
    if metric == "cosine":
        return np.einsum("ij,ij->i", a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-10), b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-10))
    return -np.sqrt(((a - b) ** 2).sum(1)) if metric == "euclidean" else -np.abs(a - b).sum(1)


def _packed(df: DataFrame, size: int, names: tuple[str, ...]) -> DataFrame:
    """Blocks of at most so many vectors, one row each. Rows with null vectors are left out. A third name is that of a column ``held`` of numbers, as many for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - len(ids))
                at += part.num_rows
                ids += part["id"].to_pylist()
                rows.append(matrix(part["v"]))
                held += [part["held"].flatten().to_numpy()] if len(names) > 2 else []
                if len(ids) == size:
                    yield _block(ids, rows, held)
                    ids, rows, held = [], [], []
        if ids:
            yield _block(ids, rows, held)

    def _block(ids, rows, held):
        data = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (rows, held) if x]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *data], list(names))

    return df.where("v IS NOT NULL").mapInArrow(run, f"{names[0]} array<bigint>, {', '.join(f'{n} binary' for n in names[1:])}")


def met(queries: DataFrame, vectors: DataFrame, *held: str, k: int = 0, width: int = 0, of: DataFrame | None = None, size: int = 0) -> DataFrame:
    """q_ids, q, ids, m: every block of queries (q_id, embedding) beside every block of vectors (id, embedding), and what the vectors' column ``held`` has.

    Nothing of the vectors is exchanged: blocks of queries go to them if they are counted to be few; else every pair of partitions meets.
    A caller that leaves k rows a query and task tells k, the width, and where vectors are best counted (``of``): the many
    queries are then stored, as each part of the vectors reads them, and the vectors are in as many parts as ``dealt`` says.
    ``size``: vectors of a block, where it isn't VECTOR_BLOCK.
    """
    importable(queries.sparkSession)
    few = is_small(queries, SENT_QUERIES)
    if k and not few:
        parts, groups = dealt(queries.count(), (vectors if of is None else of).count(), k, width, queries.sparkSession.sparkContext.defaultParallelism)
        queries, vectors = queries.coalesce(groups), vectors.coalesce(parts)
    ask = _packed(queries.select(F.col("q_id").cast("long").alias("id"), F.col("embedding").alias("v")), QUERY_BLOCK, ("q_ids", "q"))
    have = _packed(vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("v"), *held), size or VECTOR_BLOCK, ("ids", "m", *held))
    if k and not few:
        ask = stored(ask).coalesce(groups)
    return have.crossJoin(F.broadcast(ask) if few else ask.hint("shuffle_replicate_nl"))


def dealt(asked: int, n: int, k: int, width: int, cores: int) -> tuple[int, int]:
    """Parts of the vectors, so few that k rows a query and part are at most half of the vectors' bytes, and groups of the queries, so that all cores have work."""
    parts = max(1, n * width * 4 // (2 * ROW_BYTES * k * max(1, asked)))
    return parts, max(1, -(-asked // min(TASK_QUERIES, max(1, TASK_ROWS // k))), -(-cores // parts))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids and vectors of the queries, ids and vectors, and the bytes of ``held`` if there are any, of each pair of blocks that met."""
    for batch in batches:
        for q_ids, q, ids, m, *held in zip(*(batch[c] for c in ("q_ids", "q", "ids", "m", "held") if c in batch.schema.names), strict=True):
            asked, known = np.array(q_ids.as_py(), np.int64), np.array(ids.as_py(), np.int64)
            yield asked, np.frombuffer(q.as_py()).reshape(len(asked), -1), known, np.frombuffer(m.as_py()).reshape(len(known), -1), *(h.as_py() for h in held)


def best(s: np.ndarray, ids: np.ndarray, k: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest entries at nine places, ties by id; what isn't finite is left out.

    Only entries that reach the k-th greatest are sorted, those equal to it included. Where ``keep`` tells what may be
    taken, that holds instead, and NaN is greatest, as Spark has it.
    """
    if keep is None:
        keep = np.isfinite(s)
        rounded = np.where(keep, np.round(s, 9), -np.inf)
    else:
        rounded = np.where(keep, np.where(np.isnan(s), np.inf, np.round(s, 9)), -np.inf)
    if k < s.shape[1]:
        keep &= rounded >= np.partition(rounded, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    row, at = np.nonzero(keep)
    order = np.lexsort((ids[at], -rounded[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, row)
    within = np.arange(len(row)) - first < k
    return row[within], at[within]


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """q_id, id, score, rank: queries (q_id, embedding) against vectors (id, embedding). score is the similarity, or minus the distance.

    Each pair of blocks keeps its own k best, so what is shuffled is k rows a query and block.
    """
    known(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, ids, m in opened(batches):
            s = similarity(q, m, metric)
            if exclude_self:
                s[asked[:, None] == ids[None, :]] = -np.inf
            row, at = best(s, ids, k)
            yield scored(asked[row], ids[at], s[row, at])

    return top(met(queries, vectors).mapInArrow(run, SCORED), k)


def every_pair(queries: DataFrame, vectors: DataFrame, metric: str = "cosine", places: int | None = None) -> DataFrame:
    """q_id, id, score of every query and every vector, where it is finite, rounded if ``places`` says so. No row is exchanged or ranked.

    What takes disk is whoever writes the rows. So those of a pair of blocks come by their scores: equal ones lie together,
    which Parquet keeps in half the bytes that it takes query by query. A task holds the scores of one pair of blocks and their order.
    """
    known(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, ids, m in opened(batches):
            s = similarity(q, m, metric).ravel()
            order = np.argsort(s)
            for at in range(0, len(order), SLICE):
                pair = order[at : at + SLICE]
                score = s[pair]
                finite = np.isfinite(score)
                row, place = np.divmod(pair[finite], len(ids))
                yield scored(asked[row], ids[place], score[finite] if places is None else rounded(score[finite], places))
            del s, order  # before those of the next are made

    return met(queries, vectors, size=PAIR_BLOCK).mapInArrow(run, SCORED)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Finite numbers, halves away from zero as SQL has it, and no negative zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        up = x * 10.0**places
        whole = np.trunc(up)
        whole += np.copysign(np.abs(up - whole) >= 0.5, up)
    return np.where(np.isfinite(whole), whole / 10.0**places, x) + 0.0


def known(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def scored(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(ids), pa.array(scores, from_pandas=False)], ["q_id", "id", "score"])


def memory_mb(n: int, width: int) -> float:
    """Of n raw single-precision vectors."""
    return n * width * 4 / 2**20
