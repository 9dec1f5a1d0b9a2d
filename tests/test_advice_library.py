"""Bounds of what the driver takes, short texts, and indexes that follow their table."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog, experiments
from lodestone.sources import sinks


def test_driver_takes_no_more_than_its_bound(spark, monkeypatch, tmp_path):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(sinks, "LARGEST", 20)
    assert len(sinks.to_numpy(df, ["x"])[0]) == 20
    monkeypatch.setattr(sinks, "LARGEST", 19)
    with pytest.raises(ValueError, match="more than 19 rows"):
        sinks.to_numpy(df, ["x"])
    monkeypatch.setattr(sinks, "DRAWN", 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        sinks.svg(df, "id", ["x"], str(tmp_path / "a.svg"))


def test_short_texts_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six")], "id bigint, text string")
    asked = spark.createDataFrame([(7, "two three"), (8, "wo th"), (9, "none")], "q_id bigint, text string")
    assert sorted(r["q_id"] for r in experiments.verbatim_gold(docs, asked).collect()) == [7, 8]
    monkeypatch.setattr(experiments, "SHORT", 2)
    with pytest.raises(ValueError, match="more than 2 texts"):
        experiments.verbatim_gold(docs, asked)


def test_index_follows_every_file_of_its_table(spark, tmp_path):
    """A file replaced by an older one with as many rows is another state; of a table two states stay."""
    import os

    put, folders = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet"), []
    for n, word in enumerate(["alpha", "beta", "gamma"]):
        put([word, f"{word} {word}"])
        for f in (tmp_path / "documents.parquet").glob("part-*"):
            os.utime(f, (1_600_000_000 - n, 1_600_000_000 - n))
        index = catalog._index(spark, str(tmp_path))
        assert [r["term"] for r in index.terms.collect()] == [word]
        assert catalog._index(spark, str(tmp_path)) is index
        folders = [v for k, v in catalog._built.items() if k[1] == str(tmp_path)]
        assert len(folders) == min(n + 1, 2)
