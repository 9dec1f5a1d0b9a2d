"""Pairs, cells and factors against plain ones, and what the encoder makes of words and texts."""

import math
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import learned

TEXTS = ["a b c a", "B  c\nd", None, "", "e", "a b " * 40, "c c c", "d a é é", "a b c a"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id bigint, text string").repartition(3)


@pytest.mark.parametrize("part", [200_000, 1, 7])
def test_pairs_and_cells(spark, docs, monkeypatch, part):
    monkeypatch.setattr(learned, "PART", part)
    counts = Counter(w for t in TEXTS for w in (t or "").lower().split())
    words = [r["term"] for r in learned.vocabulary(docs).collect()]
    assert words == sorted((w for w in counts if counts[w] >= 2), key=lambda w: (-counts[w], w))
    expected = Counter()
    for t in TEXTS:
        line = (t or "").lower().split()
        for i, w in enumerate(line):
            for j in range(max(0, i - 3), min(len(line), i + 4)):
                if j != i and w in words and line[j] in words:
                    expected[words.index(w), words.index(line[j])] += 1
    counted = learned.pairs(docs, words, 3)
    assert {(r["row"], r["col"]): r["n"] for r in counted.collect()} == expected
    rows = Counter()
    for (w, _), n in expected.items():
        rows[w] += n
    pmi = {(w, c): math.log(n * sum(rows.values()) / (rows[w] * rows[c])) for (w, c), n in expected.items()}
    assert {(r["row"], r["col"]): r["value"] for r in learned.cells(counted).collect()} == pytest.approx({k: v for k, v in pmi.items() if v > 0})


def test_tasks_add_up_what_they_hold(spark, docs, monkeypatch):
    words = [r["term"] for r in learned.vocabulary(docs).collect()]
    whole = {tuple(r) for r in learned.pairs(docs, words).collect()}
    for held in (1, 4):
        monkeypatch.setattr(learned, "HELD", held)
        assert {tuple(r) for r in learned.pairs(docs, words).collect()} == whole


def test_eigenvalues(spark):
    rng = np.random.default_rng(0)
    axes, values = np.linalg.qr(rng.standard_normal((60, 60)))[0], np.r_[9.0, -8, 7, 6, rng.uniform(-0.1, 0.1, 56)]
    full = axes @ np.diag(values) @ axes.T
    cells = spark.createDataFrame([(i, j, float(full[i, j])) for i in range(60) for j in range(60)], "row bigint, col bigint, value double")
    found, vectors = learned.eigen(cells, 60, 4)
    assert found == pytest.approx([9, -8, 7, 6], abs=1e-4)
    assert np.abs(vectors.T @ axes[:, :4]) == pytest.approx(np.eye(4), abs=1e-3)


def test_company_tells_words_of_like_use(spark):
    rng = np.random.default_rng(1)
    lines = [" ".join(rng.choice(["cat", "dog", "cow"] if i % 2 else ["red", "blue", "green"]) + " " + rng.choice(["eats", "runs", "sleeps"] if i % 2 else ["paint", "ink", "cloth"]) for _ in range(6)) for i in range(200)]
    model = learned.CorpusEmbedder.fit(spark.createDataFrame([(t,) for t in lines], "text string"), 4)
    cat, dog, red = model.encode_texts(["cat", "dog", "red"])
    assert cat @ dog > 0.5 > cat @ red


@pytest.mark.parametrize("company", [True, False])
def test_saved_nulls_and_unknown(spark, docs, tmp_path, company):
    model = learned.CorpusEmbedder.fit(docs, 8, company=company)
    model.save(spark, str(tmp_path / "words"))
    again = learned.CorpusEmbedder.load(spark, str(tmp_path / "words"))
    texts = ["a b", None, "", "zzz", "C c"]
    assert np.array_equal(model.encode_texts(texts), again.encode_texts(texts))
    assert np.linalg.norm(again.encode_texts(texts), axis=1) == pytest.approx([1, 0, 0, 1, 1], abs=1e-5)
    empty = learned.CorpusEmbedder.fit(docs.limit(0), 8, company=company)
    assert empty.encode_texts([None, ""]).any() == False and empty.encode_texts(["a"]).any()  # noqa: E712


def test_whole_texts_are_encoded(spark, docs):
    model = learned.CorpusEmbedder.fit(docs, 8)
    filler, tail = "a " * 5000, "zzz " * 5000
    assert not np.allclose(model.encode_texts([filler + tail])[0], model.encode_texts([filler])[0])


def test_every_encoder_is_compared(spark):
    """Which of them finds most depends on the texts; the README has the figures."""
    from lodestone.plans import catalog

    found = {r["encoder"]: r for r in catalog.queries()["encoder_recall"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {"hashing", "weighted", "learnt"} and len({r["n_queries"] for r in found.values()}) == 1
    assert all(0 <= r["recall_1"] <= r["recall_10"] <= 1 for r in found.values())
