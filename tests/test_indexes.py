import numpy as np
import pytest

from lodestone.operators import dense, reduce as reduction
from lodestone.operators.ann import base, forest, graph, ivf, lsh


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(3).cache()
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "q_id").cache()
    exact = dense.exact_topk(queries, vectors, 10).collect()
    return vectors, queries, {(r["q_id"], r["id"]): r["score"] for r in exact}


def recall(found, exact) -> float:
    rows = found.collect()
    for r in rows:
        if (r["q_id"], r["id"]) in exact:
            assert r["score"] == pytest.approx(exact[r["q_id"], r["id"]], abs=1e-5)
    assert len({(r["q_id"], r["id"]) for r in rows}) == len(rows)
    return len({(r["q_id"], r["id"]) for r in rows} & set(exact)) / len(exact)


def test_lsh(spark, data):
    vectors, queries, exact = data
    normals = lsh.planes(32, 16, 5)
    buckets = lsh.signatures(vectors, normals)
    assert buckets.count() == 900 * 16
    assert recall(lsh.search(queries, vectors, buckets, normals, 10), exact) >= 0.9


def test_lsh_fallback(spark, data):
    vectors, queries, _ = data
    normals = lsh.planes(32, 1, 16)
    nothing = lsh.signatures(vectors, normals).limit(0)
    assert lsh.search(queries, vectors, nothing, normals, 3).groupBy("q_id").count().where("count = 3").count() == queries.count()


def test_ivf(spark, data, tmp_path):
    vectors, queries, exact = data
    index = ivf.IvfPq.fit(vectors)
    cells = index.cells(vectors)
    base.save({"cells": cells}, str(tmp_path), lists=len(index.centres))
    tables, manifest = base.load(spark, str(tmp_path))
    assert manifest["lists"] == len(index.centres) and tables["cells"].count() == 900
    assert recall(index.search(queries, vectors, tables["cells"], 10), exact) >= 0.9


def test_long_lists_are_cut(spark, data, monkeypatch):
    vectors, queries, exact = data
    monkeypatch.setattr(ivf, "CELL_BLOCK", 20)
    index = ivf.IvfPq.fit(vectors, 4)
    assert recall(index.search(queries, vectors, index.cells(vectors), 10, probe=4), exact) >= 0.9


def test_forest(spark, data):
    vectors, queries, exact = data
    trees = forest.Forest.fit(vectors, 20, 60)
    leaves = trees.leaves(vectors)
    assert leaves.count() == 900 * 20
    assert recall(trees.search(queries, vectors, leaves, 10), exact) >= 0.9


@pytest.mark.parametrize("shard", [10_000, 300])
def test_graph(spark, data, shard):
    vectors, queries, exact = data
    nodes = graph.build(vectors, beam=100, shard=shard)
    assert recall(graph.search(queries, nodes, 10), exact) >= 0.9


def test_levels_thin_out():
    levels = [graph.level_of(i, 0.5) for i in range(5000)]
    assert 0.8 < np.mean(np.array(levels) == 0) < 0.92 and max(levels) >= 2


def test_pca_keeps_inner_products(spark, data):
    vectors, _, _ = data
    pca = reduction.Reducer.fit(vectors, 32)
    assert sum(pca.explained) == pytest.approx(1)
    got = np.array([r["embedding"] for r in pca.transform(vectors).orderBy("id").collect()])
    x = np.array([r["embedding"] for r in vectors.orderBy("id").collect()])
    x = x - x.mean(0)
    assert np.allclose(got @ got.T, x @ x.T, atol=1e-2)
    with pytest.raises(ValueError):
        reduction.fitted(vectors, 4, "other")


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_maps_keep_neighbours(spark, method, monkeypatch):
    """Vectors of one group lie together, also those that the map was not laid out for."""
    monkeypatch.setitem(reduction.SAMPLES, method, 250)
    rng = np.random.default_rng(3)
    group = rng.integers(0, 6, 400)
    x = 4 * rng.normal(size=(6, 24))[group] + rng.normal(size=(400, 24))
    rows = [(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(group, x, strict=True))] + [(400, 0, None)]
    vectors = spark.createDataFrame(rows, "id bigint, label int, embedding array<float>").repartition(3)
    found = reduction.fitted(vectors, 2, method).transform(vectors).orderBy("id").collect()
    assert len(found) == 401 and found[400]["embedding"] is None and [r["label"] for r in found[:400]] == group.tolist()
    y = np.array([r["embedding"] for r in found[:400]])
    far = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :5]
    assert (group[near] == group[:, None]).mean() > 0.9


def test_leaves_follow_the_table(spark, data, monkeypatch, tmp_path):
    """Tops of three leaves, grown on few vectors, are split until leaves are small; a stored forest finds as much, also with parts."""
    vectors, queries, exact = data
    monkeypatch.setattr(base, "SAMPLE", 60)
    monkeypatch.setattr(forest, "DRAWN", 150)
    monkeypatch.setattr(forest, "PART", 50)
    top = forest.Forest.fit(vectors, 20, 30)
    model, leaves = top.split(vectors, 60)
    sizes = [r["count"] for r in leaves.groupBy("tree", "leaf").count().collect()]
    assert sum(sizes) == 900 * 20 and max(sizes) <= 60 and model.rounds >= 1
    assert {tuple(r) for r in model.leaves(vectors).collect()} == {tuple(r) for r in leaves.select("id", "tree", "leaf").collect()}
    model.save(str(tmp_path), leaves)
    again, kept = forest.Forest.load(spark, str(tmp_path))
    assert recall(again.search(queries, vectors, kept, 10), exact) >= 0.9


def test_equal_vectors_stay_together(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i >= 90)]) for i in range(100)], "id bigint, embedding array<float>")
    model, leaves = forest.Forest.fit(vectors, 2, 10).split(vectors, 20)
    assert leaves.count() == 200 and max(r["count"] for r in leaves.groupBy("tree", "leaf").count().collect()) >= 90
