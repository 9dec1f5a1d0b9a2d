"""Decontamination against brute force over all windows, for items of 1 to 56 shingles at and around the similarity."""

import random
from collections import Counter, defaultdict

import pytest

from lodestone.llm import decontaminate


def shingles(text):
    words = text.lower().split()
    return [tuple(words[j : j + 5]) for j in range(len(words) - 4)] or ([tuple(words)] if words else [])


def expected(docs, items):
    """Best similarity of any window, for each (document, item) that leaks."""
    wanted = [(i, Counter(shingles(t or ""))) for i, t in items]
    having = defaultdict(list)
    for at, (_, counts) in enumerate(wanted):
        for s in counts:
            having[s].append(at)
    out = {}
    for d, text in docs:
        own = shingles(text or "")
        for at in {at for s in own for at in having[s]}:
            i, counts = wanted[at]
            m = sum(counts.values())
            for start in range(max(0, len(own) - m) + 1):
                window = Counter(own[start : start + m])
                common = sum((window & counts).values())
                similarity = common / (m + sum(window.values()) - common)
                if similarity >= 0.8:
                    out[d, i] = max(similarity, out.get((d, i), 0))
    return out


def held(spark, docs, items):
    put = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, text string")
    found = decontaminate.leaks(put(docs, "doc_id"), put(items, "item_id")).collect()
    assert {(r["id"], r["item_id"]): r["similarity"] for r in found} == pytest.approx(expected(docs, items))
    return len(found)


def test_every_window_at_the_similarity(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items, docs = [], []
    for n in range(5, 61):
        for k in range(4):
            item, m = words(n), n - 4
            items.append((len(items), " ".join(item)))
            edge = [m // 5, m // 9, m // 5 + 1, m // 9 + 1][k]  # as many as may be missing from a short text, from a window, and one more
            part = item[: n - edge]
            docs.append((len(docs), " ".join(part if k % 2 == 0 else [*words(20), *part, *words(20)])))
    assert held(spark, docs, items) >= 100


def test_items_of_one_size_repeats_and_ties(spark):
    rng = random.Random(2)
    few = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, few(12)) for i in range(30)] + [(40, "a " * 12), (41, "a " * 9), (5, few(12)), (None, "x y z u v w"), (None, None), (50, "x y z u v w"), (50, "x y z u v w")]
    docs = [(i, few(40)) for i in range(20)] + [(30, "A\tb  " + "a " * 200), (31, items[3][1].upper()), (32, "X y z u v w " * 3), (None, items[4][1]), (33, ""), (34, None)]
    assert held(spark, docs, items) > 10
