"""The stored table of blocks: what joins with it exchange, and what writing it leaves behind."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import blocks
from lodestone.llm.common import discard, made


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_answers_come_to_the_blocks_and_no_block_is_exchanged(spark, sf_dir, monkeypatch, no_broadcast):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 300)
    packed = blocks.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    numbers = [r["block"] for r in packed.select("block").collect()]
    given = [(b, k, bytes([k])) for b in numbers[1:] for k in (2, 0, 1)]
    joined = blocks.with_answers(packed, spark.createDataFrame(given, "block bigint, bucket int, answer binary"))
    # The one exchange is that of the answers; blocks are read where they lie.
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    found = {r["block"]: r for r in joined.collect()}
    assert len(numbers) > 9 and sorted(found) == sorted(numbers) and found[numbers[0]]["answers"] is None
    assert all([x["bucket"] for x in found[b]["answers"]] == [0, 1, 2] for b in numbers[1:])
    assert sum(r["n_words"] for r in found.values()) == packed.agg(F.sum("n_words")).first()[0]


def test_no_name_stays_in_the_catalog_and_the_rows_go_with_their_folder(spark, sf_dir):
    tables = spark.catalog.listTables("spark_catalog.default")
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    spark.catalog.setCurrentDatabase("elsewhere")
    try:
        with made() as folders:
            packed = blocks.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        assert not spark.catalog.listTables() and spark.catalog.listTables("spark_catalog.default") == tables
    finally:
        spark.catalog.setCurrentDatabase("default")
    assert sum(len(r["ids"]) for r in packed.collect()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    (folder,) = folders
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    discard(folder)
    assert not files.exists(path)
