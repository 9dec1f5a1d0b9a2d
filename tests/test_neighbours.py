"""Neighbour graphs against exact search, memberships and trust against plain numpy, and maps of grouped vectors."""

import numpy as np
import pytest

from lodestone.operators import neighbours, reduce


def table(spark, x, extra=()):
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *extra], "id bigint, embedding array<float>").repartition(3)


def far(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(0)
    return np.concatenate([c + 0.3 * rng.standard_normal((75, 16)) for c in 2 * rng.standard_normal((8, 16))]).astype(np.float32)


@pytest.fixture(scope="module")
def edges(spark, grouped):
    return neighbours.graph(table(spark, grouped, [(9999, None)]), 10, leaf=60).cache()


def test_graph_finds_the_nearest(edges, grouped):
    x, found = grouped.astype(np.float64), {}
    for r in edges.collect():
        found.setdefault(r["id"], []).append((r["far"], r["other"]))
    d = far(x)
    np.fill_diagonal(d, np.inf)
    assert set(found) == set(range(len(x))) and all(len(v) == 10 for v in found.values())
    assert all(f == pytest.approx(d[i, j], abs=1e-6) for i, v in found.items() for f, j in v)
    hits = sum(len({j for _, j in found[i]} & set(np.argsort(d[i], kind="stable")[:10].tolist())) for i in found)
    assert hits >= 0.9 * 10 * len(x)


def test_copies_that_no_tree_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 40)
    x = np.concatenate([np.ones((300, 4)), np.random.default_rng(1).standard_normal((100, 4))]).astype(np.float32)
    found = neighbours.graph(table(spark, x), 5, trees=4, leaf=20).collect()
    each = {i: [r["far"] for r in found if r["id"] == i] for i in range(400)}
    assert all(each[i] == [0.0] * 5 for i in range(300)) and all(0 < len(each[i]) <= 5 for i in range(300, 400))


def test_memberships_of_both_directions(spark, edges):
    rows = edges.collect()
    near, expected = {}, {}
    for r in sorted(rows, key=lambda r: (r["id"], r["far"], r["other"])):
        near.setdefault(r["id"], []).append(r)
    one = {}
    for i, own in near.items():
        w = reduce._weights(np.array([[r["far"] for r in own]]), np.log2(len(own) + 1), False)[0]
        one |= {(i, r["other"]): v for r, v in zip(own, w, strict=True)}
    for i, j in one:
        a, b = one[i, j], one.get((j, i), 0.0)
        expected[i, j] = expected[j, i] = a + b - a * b
    got = {(r["id"], r["other"]): r["w"] for r in neighbours.weights(edges).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("block", [5000, 100])
def test_map_keeps_groups(spark, grouped, edges, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    have = table(spark, grouped, [(9999, None)])
    places = neighbours.drawn_map(have, edges=edges).cache()
    again = neighbours.drawn_map(have.repartition(2), edges=edges.repartition(5))
    y = {r["id"]: r["embedding"] for r in places.collect()}
    other = {r["id"]: r["embedding"] for r in again.collect()}
    assert set(y) == set(other) == set(range(len(grouped)))
    y, other = (np.array([m[i] for i in range(len(grouped))]) for m in (y, other))
    assert np.allclose(y, other, atol=1e-9)
    d = far(y)
    np.fill_diagonal(d, np.inf)
    assert (np.argmin(d, 1) // 75 == np.arange(len(grouped)) // 75).mean() > 0.95


@pytest.mark.parametrize("k", [3, 10])
def test_trust(spark, grouped, k):
    x = grouped[::8].astype(np.float64)
    x[5] = x[6]
    y, n = x[:, :2], len(x)
    near, ranks = far(y), far(x)
    penalty = {}
    for i in range(n):
        others = [j for j in range(n) if j != i]
        first = sorted(others, key=lambda j: (round(near[i, j], 9), j))[:k]
        penalty[i] = sum(max(0, 1 + sum(round(ranks[i, m], 9) < round(ranks[i, j], 9) for m in others) - k) for j in first)
    have = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    places = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id bigint, embedding array<double>")
    asked = have.selectExpr("id AS q_id")
    assert {r["q_id"]: r["penalty"] for r in neighbours.trust(have, places, asked, k).collect()} == penalty
    worst = k * (2 * n - 3 * k - 1) / 2
    assert neighbours.trustworthiness(have, places, asked, k).first()["trust"] == pytest.approx(1 - sum(penalty.values()) / n / worst)
    assert neighbours.trustworthiness(have, have, asked, k).first()["trust"] == 1


def test_fewer_vectors_than_neighbours(spark):
    for n in (0, 1, 3):
        have = table(spark, np.random.default_rng(n).standard_normal((n, 4)).astype(np.float32), [(77, None)])
        assert neighbours.graph(have, 5).count() == n * (n - 1)
        assert sorted(r["id"] for r in neighbours.drawn_map(have).collect()) == list(range(n))
        neighbours.trust(have.where("embedding IS NOT NULL"), neighbours.drawn_map(have), have.selectExpr("id AS q_id"), 5).collect()
