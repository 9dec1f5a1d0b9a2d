"""Retrieval is batch-only; a stream of queries or documents runs the same plans in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers every micro-batch of a stream of queries with one plan. A repeated batch overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
