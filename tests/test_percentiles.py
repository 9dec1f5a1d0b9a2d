"""Percentiles by histograms against numpy, also where bins are cut again and again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics

AT = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("few", [1_000_000, 40, 1])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(metrics, "SORTED", few)
    monkeypatch.setattr(metrics, "BINS", 16)
    rng = np.random.default_rng(1)
    groups = {"even": rng.uniform(0, 1, 900), "same": np.full(500, 3.5), "far": np.r_[rng.normal(0, 1, 700), 1e12, -1e9], "one": [7.0], "two": [1.0, 2.0], "steps": rng.integers(0, 4, 600).astype(float), "small": rng.uniform(0, 1e-300, 300)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("nulls", None), ("even", None), (None, 5.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    found = {r["g"]: r for r in metrics.percentiles(df, "x", AT, "g").collect()}
    assert set(found) == {*groups, "nulls", None} and all(found["nulls"][f"p{i}"] is None for i in range(len(AT)))
    for g, xs in [*groups.items(), (None, [5.0, 6.0])]:
        assert [found[g][f"p{i}"] for i in range(len(AT))] == pytest.approx(np.quantile(xs, AT).tolist(), rel=1e-12, abs=1e-305), g
    whole = metrics.percentiles(df.where("g = 'even'"), "x", (0.5,)).first()
    assert whole["p0"] == pytest.approx(np.median(groups["even"]))


def test_no_buffer_of_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plan = metrics.latency(df, "x", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan
