"""The class model against plain sums: the gain of a move, and scores from the words' classes."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import blocks, class_lm
from lodestone.llm.common import crc_bucket


def information(m):
    """What exchange maximises, up to a constant: the sum of n log n over pairs less those over both margins."""
    f = lambda x: sum(v * math.log(v) for v in np.asarray(x, float).ravel() if v > 0)
    return f(m) - f(m.sum(0)) - f(m.sum(1))


def test_a_move_gains_most_of_all_classes():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, classes = 9, 5
        bigrams = rng.integers(0, 4, (n, n)) * rng.integers(0, 2, (n, n))
        of = np.array([0, *rng.integers(1, classes, n - 1)])
        u = int(rng.integers(1, n))

        def matrix(labels, bigrams=bigrams, classes=classes):
            m = np.zeros((classes, classes))
            np.add.at(m, (labels[:, None], labels[None, :]), bigrams)
            return m

        gains = {}
        for c in range(1, classes):
            moved = of.copy()
            moved[u] = c
            gains[c] = information(matrix(moved))
        own = float(bigrams[u, u])
        right, left = np.bincount(of, bigrams[u], classes), np.bincount(of, bigrams[:, u], classes)
        right[of[u]] -= own
        left[of[u]] -= own
        new = class_lm.best_class(matrix(of).astype(float), int(of[u]), right.astype(float), left.astype(float), own, 1e-9)
        assert gains[new] == pytest.approx(max(gains.values()))
        assert new == of[u] or gains[new] > gains[of[u]]


def test_many_words_are_weighed_as_one_by_one():
    rng = np.random.default_rng(7)
    classes, k = 7, 300
    right, left = (rng.integers(0, 4, (k, classes)) * (rng.random((k, classes)) < 0.3) for _ in range(2))
    right[:5] = left[3:8] = 0
    own, old = rng.integers(0, 3, k), rng.integers(1, classes, k)
    m = rng.integers(0, 50, (classes, classes)).astype(float)
    for i in range(k):  # what a word has is in the sums of its class
        m[old[i]] += right[i]
        m[:, old[i]] += left[i]
        m[old[i], old[i]] += own[i]
    got = class_lm.best_classes(m, old, right.astype(float), left.astype(float), own.astype(float), 1e-9)
    one = [class_lm.best_class(m.copy(), int(old[i]), right[i].astype(float), left[i].astype(float), float(own[i]), 1e-9) for i in range(k)]
    assert got.tolist() == one and len(set(one)) > 2 and (got != old).any()


def test_exchange_ends_where_no_move_gains():
    rng = np.random.default_rng(6)
    bigrams = rng.integers(0, 5, (30, 30)).astype(float)
    of = class_lm.exchange(bigrams, 6)

    def value(labels):
        m = np.zeros((6, 6))
        np.add.at(m, (labels[:, None], labels[None, :]), bigrams)
        return information(m)

    reached = value(of)
    for u in range(1, 30):
        for c in range(1, 6):
            moved = of.copy()
            moved[u] = c
            assert value(moved) <= reached + 1e-6


def test_scores_from_plain_sums(spark, sf_dir, rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 700)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = crc_bucket(F.col("doc_id"), 7) != 2
    answered, model, buckets = class_lm.fit(docs, train)
    told = {}
    for row in answered.collect():
        block = blocks.Block(row.asDict(recursive=True))
        counts, classes = class_lm._answered(row.asDict(recursive=True), block, buckets)
        for w, n, c in zip(block.words, counts.tolist(), classes.tolist(), strict=True):
            assert told.setdefault(w, (n, c)) == (n, c)
    texts = {i: t.encode().lower().split() for i, t, *_ in rows[0]}
    learned = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in learned for w in ws)
    assert all(told[w][0] == counts[w] for w in told) and set(counts) <= set(told)
    moves, tokens, once = Counter(), Counter(), Counter()
    for ws in learned:
        line = [0, *(told[w][1] for w in ws), 0]
        moves.update(zip(line, line[1:], strict=False))
        tokens.update(line[1:])
    once.update(told[w][1] for w, n in counts.items() if n == 1)
    k, total = class_lm.CLASSES, sum(moves.values())
    into, out = Counter(), Counter()
    for (a, b), n in moves.items():
        into[b] += n
        out[a] += n

    def transition(a, b):
        share = (into[b] + 1) / (total + k)
        return (moves[a, b] + class_lm.TRANSITION_PRIOR * share) / (out[a] + class_lm.TRANSITION_PRIOR)

    def emission(w):
        c = told[w][1]
        fresh = (once[c] + 0.5) / (tokens[c] + 1) if tokens[c] else 1.0
        return (1 - fresh) * counts[w] / tokens[c] if counts[w] else fresh

    for a in range(k):
        assert sum(transition(a, b) for b in range(k)) == pytest.approx(1)
    got = {r["id"]: r["score"] for r in class_lm.fit_and_score(docs, train).collect()}
    for i, ws in texts.items():
        line = [0, *(told[w][1] for w in ws), 0]
        expected = sum(math.log10(transition(a, b)) for a, b in zip(line, line[1:], strict=False)) + sum(math.log10(emission(w)) for w in ws)
        assert got[i] == pytest.approx(expected), i
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    words = sum(len(texts[i]) + 1 for i in held)
    assert 10 ** (-sum(got[i] for i in held) / words) < len(counts)  # perplexity
