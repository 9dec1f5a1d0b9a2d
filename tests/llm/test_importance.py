"""Operator 11 against strings that are made, and a draw by plain sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import importance

TEXTS = ["The Cat sat_on the mat; the END", "", None, "é日本 x", "a " * 40, "one", "Zürich 2024-11 \x00tab\tÀB" * 30, "x" * 70_000 + " y"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, max_n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
def test_crcs_of_runs(max_n):
    sizes, crcs, owner = importance.Features(max_n).of(TEXTS)
    assert sizes.tolist() == [len(words(t)) for t in TEXTS]
    for i, t in enumerate(TEXTS):
        assert Counter(crcs[owner == i].tolist()) == Counter(features(t, max_n))


def plain(docs, target, percent, least, seed, max_n, buckets):
    s, t = (Counter(c % buckets for x in side for c in features(x, max_n)) for side in ([d for _, d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        f = features(text, max_n)
        weight = sum(gain(c % buckets) for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("max_n", "percent", "least"), [(1, 10, 20), (2, 35, 1), (3, 100, 0), (1, 0, 1)])
def test_draw(spark, max_n, percent, least):
    rng = np.random.default_rng(max_n)
    some = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 50)) for i in range(300)]
    docs = [*some, *some[:20], (None, some[0][1]), (None, None), *enumerate(TEXTS, 900)]
    target = [" ".join(f"w{x}" for x in rng.integers(0, 10, 80)), None, "w1 W2"]
    made = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id bigint, text string, KEY string, score int")
    found = importance.resample(made, spark.createDataFrame([(x,) for x in target], "text string"), percent, least, 2024, max_n, 500)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, target, percent, least, 2024, max_n, 500)


def test_draw_of_equal_scores(spark):
    rows = [(i, 30, 1, 0, i % 2) for i in range(50)]
    scored = spark.createDataFrame(rows, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    found = {r["id"]: r["rank"] for r in importance.draw(scored, 30, F.col("n_words") >= 20).collect()}
    assert {i: r for i, r in found.items() if r} == {2 * k + 1: k + 1 for k in range(15)}


def test_prefers_the_target(spark):
    docs = spark.createDataFrame([(i, ("red green " if i % 2 else "up down ") * 20) for i in range(400)], "doc_id bigint, text string")
    drawn = importance.resample(docs, spark.createDataFrame([("red green " * 50,)], "text string"), 25).where("rank IS NOT NULL")
    assert drawn.count() == 100 and drawn.where("id % 2 = 1").count() > 90
