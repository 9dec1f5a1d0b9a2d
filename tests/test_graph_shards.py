"""Graphs in several shards: routing, later vectors, compaction; lists and their centres over whole tables."""

import numpy as np
import pytest

from lodestone.operators import dense
from lodestone.operators.ann import base, graph, ivf, kmeans
from lodestone.operators.ann.index import VectorIndex
from lodestone.session import stored


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 2400)] + 0.35 * rng.normal(size=(2400, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(4).cache()
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "q_id").cache()
    return vectors, queries, {(r["q_id"], r["id"]) for r in dense.exact_topk(queries, vectors, 10).collect()}


def recall(found, exact):
    return len({(r["q_id"], r["id"]) for r in found.collect()} & exact) / len(exact)


def test_a_quarter_of_the_shards(spark, data):
    vectors, queries, exact = data
    nodes = stored(graph.build(vectors, beam=60, shard=150))
    sizes = [r["count"] for r in nodes.groupBy("shard").count().collect()]
    assert len(sizes) >= 16 and max(sizes) <= 250 and sum(sizes) == 2400
    assert nodes.where("centre IS NOT NULL").count() == len(sizes)
    visit = len(sizes) // 4
    visited = graph.routed(queries, nodes, visit).groupBy("q_id").count()
    assert visited.where(f"count = {visit}").count() == queries.count()
    assert recall(graph.search(queries, nodes, 10, visit), exact) >= 0.9


def test_many_queries_of_one_shard(spark, data, monkeypatch):
    vectors, queries, exact = data
    nodes = stored(graph.build(vectors, beam=60, shard=1200))
    whole = {tuple(r) for r in graph.search(queries, nodes, 5).collect()}
    monkeypatch.setattr(graph, "QUERIES", 7)
    assert {tuple(r) for r in graph.search(queries, nodes, 5).collect()} == whole


@pytest.mark.parametrize("size", [400, 5000])
def test_two_batches(spark, data, tmp_path, size):
    """What comes later is found at once, and after compaction by insertion or by dealing anew; known ids stay as they are."""
    vectors, queries, exact = data
    index = VectorIndex.build(vectors.where("id % 3 > 0"), "graph", str(tmp_path / "index"), beam=60, shard=size)
    index = index.add(vectors, beam=60, shard=size)
    assert index.manifest["n"] == 2400 and index.tables["nodes"].count() == 2400
    assert recall(index.search(queries, 10), exact) >= 0.9
    late = index.manifest["first_late"]
    index = index.compact(beam=60, shard=size)
    again = VectorIndex(spark, index.path)
    assert again.tables["nodes"].select("id").distinct().count() == again.tables["nodes"].count() == 2400
    assert again.tables["nodes"].where(f"shard >= {late}").count() == 0 or size == 400
    assert "first_late" not in again.manifest and recall(again.search(queries, 10), exact) >= 0.9
    assert again.compact() is again


@pytest.mark.parametrize("kind", ["flat", "ivfpq", "lsh", "forest"])
def test_other_indexes_take_more(spark, data, kind):
    vectors, queries, exact = data
    parameters = {"lsh": {"tables": 16, "bits": 4}, "forest": {"trees": 20, "leaf": 80}}.get(kind, {})
    index = VectorIndex.build(vectors.where("id % 3 > 0"), kind, **parameters).add(vectors)
    assert index.manifest["n"] == 2400 and recall(index.search(queries, 10), exact) >= 0.9


def test_lloyd_over_the_table(spark, data):
    vectors, _, _ = data
    x = np.array([r["embedding"] for r in vectors.orderBy("id").collect()], np.float64)
    centres = x[:9].copy()
    for _ in range(3):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(9)])
    assert np.allclose(kmeans.lloyd(vectors, x[:9].copy(), 3).centres, centres)


def test_two_levels_follow_the_table(spark, data, monkeypatch):
    """Beyond the sample all vectors move the centres; two levels have less error than one of a quarter of the lists."""
    vectors, queries, exact = data
    error = lambda lists: kmeans.assigned(vectors, lists, unit=True).selectExpr("avg(far)").first()[0]
    two = kmeans.two_levels(vectors, 64, 3, unit=True)
    one = kmeans.lloyd(vectors, kmeans.scaled(kmeans.first_centres(vectors, 16)), 3, unit=True)
    assert len(two) >= 64 and error(two) < error(one)
    x = kmeans.scaled(np.array([r["embedding"] for r in queries.collect()], np.float64))
    number, far = two.nearest(x)
    assert (two.probes(x, 5)[:, 0] == number).mean() > 0.8 and (far >= 0).all()
    monkeypatch.setattr(base, "SAMPLE", 500)
    monkeypatch.setattr(ivf, "FLAT", 20)
    for lists in (16, 49):
        index = ivf.IvfPq.fit(vectors, lists)
        assert (index.groups is None) == (lists == 16)
        assert recall(index.search(queries, vectors, index.cells(vectors), 10, probe=12), exact) >= 0.9
    assert kmeans.lists_of(500) == 12 and kmeans.lists_of(10**8) == 10_000 and kmeans.lists_of(10**12, 512) == 15_625
