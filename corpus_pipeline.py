"""From raw documents to tokens: five stages, each written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import stages
from lodestone.llm.common import discard, made, stored, table

STAGES = [
    ("language ID", stages.identify),
    ("SimHash near-dedup", stages.deduplicate),
    ("benchmark decontamination", stages.decontaminate_),
    ("secret scans", stages.mask_secrets),
    ("byte-level BPE", stages.tokenise),
]
#: SQL can't express language ID, the guess cost of secrets or BPE merges; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with made() as folders:
            docs = stored(stage(spark, docs, sf_dir))
        discard(*folders[:-1], *before)  # what the stage kept on the way to its rows, and what it has read
        before = folders[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
