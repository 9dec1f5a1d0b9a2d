"""Operator 13 against all distances."""

import hashlib

import numpy as np
import pytest

from lodestone.llm import dual_tree
from lodestone.llm.dual_tree import Tree, walk


def sets():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (12, 64))
    yield "groups", centres[rng.integers(0, 12, 2000)] + rng.integers(-9, 9, (2000, 64)), 24
    yield "ties", rng.integers(-2, 3, (900, 3)), 40
    yield "plane", rng.integers(-300, 300, (3000, 2)), 60
    yield "copies", np.repeat(rng.integers(-9, 9, (7, 64)), 50, axis=0), 20
    yield "one", np.zeros((1, 5), int), 1
    yield "same", np.zeros((90, 5), int), 4
    yield "far", rng.integers(-(1 << 27), 1 << 27, (200, 64)), 9


@pytest.mark.parametrize(("name", "points", "k"), list(sets()), ids=lambda x: x if isinstance(x, str) else "")
def test_walk(name, points, k):
    vectors, centroids = Tree.build(points, 16), Tree.build(points[:k], 1)
    begin, end, of, owner, computed = walk(vectors, centroids)
    for a, b, c in zip(begin, end, of, strict=True):
        assert (owner[a:b] == -1).all()
        owner[a:b] = c
    found = np.empty(len(points), int)
    found[vectors.order] = centroids.order[owner]
    assert (found == ((points[:, None] - points[None, :k]) ** 2).sum(-1).argmin(1)).all()
    if name in ("groups", "plane"):
        assert computed < 0.5 * len(points) * k


def test_cover_tree():
    """Points lie within their node's radius, children tile their parent, and centres of children are apart."""
    for _, points, _ in sets():
        t = Tree.build(points, 4)
        for n in range(len(t.begin)):
            own = t.points[t.begin[n] : t.end[n]].astype(float)
            away = np.sqrt(((own - t.points[t.centre[n]]) ** 2).sum(1))
            assert away.max() <= t.radius[n] * (1 + 1e-12) and t.begin[n] <= t.centre[n] < t.end[n]
            below = range(t.child[n], t.child[n] + t.children[n])
            if below:
                assert [t.begin[n], *(t.end[c] for c in below)] == [*(t.begin[c] for c in below), t.end[n]]
                half = 2.0 ** (np.ceil(np.log2(t.radius[n])) - 1)
                centres = t.points[[t.centre[c] for c in below]].astype(float)
                apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(-1)) + np.eye(len(below)) * 1e18
                assert len(below) == 1 or apart.min() > half
                assert all(t.radius[c] <= half for c in below)


def plain(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                new = [sum(x) // len(own) for x in zip(*own, strict=True)]
                centroids = [*centroids[:c], new, *centroids[c + 1 :]]
    last = [(i, nearest(v), v) for i, v in kept]
    inertia = {c: sum(apart(v, centroids[c]) for _, o, v in last if o == c) for c in range(len(centroids))}
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, apart(v, centroids[c]), inertia[c], sum(inertia.values()), sha(c)) for i, c, v in last), key=repr)


@pytest.mark.parametrize(("n", "dim", "k", "rounds", "spread"), [(400, 6, 9, 4, 1.0), (60, 3, 16, 2, 0.02), (5, 8, 16, 3, 1.0), (300, 4, 1, 2, 3.0)])
def test_cluster(spark, monkeypatch, n, dim, k, rounds, spread):
    monkeypatch.setattr(dual_tree, "BLOCK", 64)
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(0, spread, dim)]) for i in range(n)]
    rows += [*rows[:3], (None, [0.5] * dim), (None, [0.5] * dim), (7, None), (8, [0.5] * (dim - 1)), (9, [None] * dim), (10, [float("nan")] * dim)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, Cluster int, ids string").repartition(3)
    found = dual_tree.cluster(df, k, rounds, dim, 10, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, k, rounds, dim, 10, 3)


def test_components_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        dual_tree.cluster(df, dim=2).collect()
