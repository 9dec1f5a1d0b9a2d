"""What the operators share: tables in the shared folder, Arrow maps over texts, free column names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import discard, folders_since, importable, made, shared_folder, stored, table

__all__ = ["crc_bucket", "discard", "folders_since", "free_name", "give_back", "made", "map_rows", "shared_folder", "stored", "table", "texts_of"]

def free_name(df: DataFrame, base: str) -> str:
    """A column name that the input doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, as ``id`` and ``text``; whatever else the table has can't clash."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def crc_bucket(column, n: int):
    """crc32 of the value as text, modulo n; null ids count as bucket -1, so they are never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(-1))


#: Rows that a function of map_rows gets at once: an Arrow batch holds up to 64 MB, and Python copies what it touches.
SLICE = 256


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once a task and returns the function for slices of its batches.

    A worker serves many tasks, so what a task leaves free goes back to the system at its end.
    """
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield apply(batch.slice(at, SLICE))
        del apply
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
