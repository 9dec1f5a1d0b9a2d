"""Operator 1: a class-based bigram language model after Brown et al., with classes from exchange clustering.

p(word | previous word) = p(class | previous word's class) * p(word | class).

Clustering begins with units: each of the most frequent words is a unit, and the other words form one unit for each
group of endings. Unit bigrams are counted over all training text; the exchange algorithm moves one unit at a time to
the class that gains most average mutual information, until nothing moves. Then every other word of the training text,
however many there are, takes by its own neighbours the class that gains most beside the units' classes, in one
distributed pass. Only unseen words keep the class of their ending. Transitions are counted again in the words' classes,
over all training text, and are smoothed towards the class's own share. Emissions use the
exact count of every word over all training text; a class's unseen words share the mass that its words seen once have.

Texts are lower-cased (A-Z), words are runs other than blank and \\t to \\r, and each text ends in an end token, which
is also the context of its first word. Word counts are exchanged once for each distinct word of a block of documents.

Ids are integers. Nulls are empty texts, of one token. A null id is never held out. Without training text every probability is that of
unseen words in one class. Repeated rows are counted and scored as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import blocks as B
from lodestone.llm.common import stored
from lodestone.session import importable

#: Units: frequent words by themselves, the others by a hash of their last bytes. Unit 0 is the end token.
FREQUENT, ENDINGS, ENDING_BYTES = 1000, 500, 3
CLASSES = 48
#: Moves must gain this share of the sum of n log n at least, which is above what rounding gives.
LEAST_GAIN = 1e-12
#: Words that are weighed at once.
AT_ONCE = 2048
#: Weight of a class's own share in its transition probabilities.
TRANSITION_PRIOR = 2.0


def unit_of(word: bytes, frequent: dict[bytes, int]) -> int:
    return frequent.get(word) or 1 + FREQUENT + xxhash.xxh32_intdigest(word[-ENDING_BYTES:]) % ENDINGS


def xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1.0))


def best_class(m: np.ndarray, old: int, right: np.ndarray, left: np.ndarray, own: float, least: float) -> int:
    """Where a unit gains most; takes it out of its old class in ``m``. Neighbours are given without the unit itself."""
    m[old] -= right
    m[:, old] -= left
    m[old, old] -= own
    rows, cols, d = m.sum(1) + left, m.sum(0) + right, np.diag(m)  # what stands beside the unit counts in its own class's margins
    a, b = np.flatnonzero(right), np.flatnonzero(left)
    gain = (xlogx(m[:, a] + right[a]) - xlogx(m[:, a])).sum(1) + (xlogx(m[b] + left[b, None]) - xlogx(m[b])).sum(0)
    gain += xlogx(d + right + left + own) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
    gain -= xlogx(rows + right.sum() + own) - xlogx(rows) + xlogx(cols + left.sum() + own) - xlogx(cols)
    gain[0] = -np.inf
    new = int(gain.argmax())
    return old if gain[new] <= gain[old] + least else new


def best_classes(m: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """best_class of many units at once, each for itself against the same ``m``: rows of ``right`` and ``left`` are units."""
    k, at = len(old), np.arange(len(old))
    rs, ls = right.sum(1) + own, left.sum(1) + own
    gain = np.zeros((k, len(m)))
    for side, pairs, other in ((right, m.T, left), (left, m, right)):
        unit, place = np.nonzero(side)  # what stands on this side, by classes
        n = side[unit, place]
        beside = pairs[place].astype(np.float64)  # what every class has beside it, and then without the unit itself
        self_ = place == old[unit]
        beside[self_] -= other[unit[self_]]
        beside[np.arange(len(unit)), old[unit]] -= n + self_ * own[unit]
        starts = np.searchsorted(unit, at)
        some = np.flatnonzero(np.bincount(unit, minlength=k))
        if len(some):
            gain[some] += np.add.reduceat(xlogx(beside + n[:, None]) - xlogx(beside), starts[some])
    d = np.repeat(np.diag(m)[None], k, 0)
    rows, cols = np.repeat(m.sum(1)[None], k, 0), np.repeat(m.sum(0)[None], k, 0)
    d[at, old] -= right[at, old] + left[at, old] + own
    rows[at, old] -= rs
    cols[at, old] -= ls
    gain += xlogx(d + right + left + own[:, None]) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
    gain -= xlogx(rows + rs[:, None]) - xlogx(rows) + xlogx(cols + ls[:, None]) - xlogx(cols)
    gain[:, 0] = -np.inf
    new = gain.argmax(1)
    return np.where(gain[at, new] <= gain[at, old] + least, old, new)


def put(m: np.ndarray, new: int, right: np.ndarray, left: np.ndarray, own: float) -> None:
    m[new] += right
    m[:, new] += left
    m[new, new] += own


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of every unit: class 0 is the end token's alone, the others by exchange, from the most frequent unit on."""
    bigrams = bigrams.astype(np.float64)
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    least = 1e-9 + LEAST_GAIN * float(xlogx(bigrams.sum()))
    order = np.lexsort((np.arange(n), -weight))
    order = order[order != 0]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % max(1, classes - 1)
    hot = np.zeros((n, classes))
    hot[np.arange(n), of] = 1
    m = hot.T @ bigrams @ hot
    back = np.ascontiguousarray(bigrams.T)
    moved = True
    while moved:
        moved = False
        for u in order:
            if not weight[u]:
                continue
            old, own = of[u], bigrams[u, u]
            right = np.bincount(of, bigrams[u], classes)
            left = np.bincount(of, back[u], classes)
            right[old] -= own
            left[old] -= own
            of[u] = best_class(m, old, right, left, own, least)
            moved |= bool(of[u] != old)
            put(m, of[u], right, left, own)
    return of


@dataclass
class Model:
    """Of a fixed size: the frequent words, the class of each unit, logarithms of transitions, and sums of each class."""

    frequent: dict[bytes, int]
    of: np.ndarray
    transition: np.ndarray
    tokens: np.ndarray
    once: np.ndarray
    train_tokens: int
    train_types: int
    ends: int

    def classes(self, words: list[bytes]) -> np.ndarray:
        return self.of[[unit_of(w, self.frequent) for w in words]] if words else np.zeros(0, np.int64)

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 p(word | class) by the word's training count; unseen words of a class count as one."""
        n, once = self.tokens[classes], self.once[classes]
        fresh = np.where(n > 0, (once + 0.5) / (n + 1.0), 1.0)
        return np.log10(np.where(counts > 0, (1 - fresh) * counts / np.maximum(n, 1), fresh))

    def end_emission(self) -> float:
        return 0.0

    def base(self, counts):
        return np.log10((counts + 1.0) / (self.train_tokens + self.train_types + 1.0))


def _slices(block: B.Block, buckets: int):
    """bucket, places of its words in the block."""
    if block.words:
        keys = B.digests(block.words)[:, 0]
        order = np.argsort(keys, kind="stable")
        for bucket, a, b in B.slices(keys[order], buckets):
            yield bucket, order[a:b]


def _line(block: B.Block, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text with an end token (0) before and behind it, the end of one being the start of the next; where the words stand; the text of every step."""
    at = np.arange(len(block.codes)) + block.owner + 1 if len(block.codes) else np.zeros(0, np.int64)
    line = np.zeros(len(block.codes) + len(block.sizes) + 1, np.int64)
    line[at] = of_words[block.codes] if len(block.codes) else 0
    return line, at, np.repeat(np.arange(len(block.sizes)), block.sizes + 1)


def _ask(row: dict, buckets: int):
    """bucket, words and their training counts."""
    block = B.Block(row)
    counts = np.bincount(block.codes[block.flags[block.owner]], minlength=len(block.words)) if block.words else None
    for bucket, at in _slices(block, buckets):
        at = at[counts[at] > 0]
        if len(at):
            yield bucket, {"words": b"\n".join([block.words[i] for i in at.tolist()]), "counts": B.narrow(counts[at])}


def _count(table: pa.Table) -> pa.Table:
    """The most frequent words of the bucket."""
    total: dict[bytes, int] = {}
    for x in table["asked"]:
        for w, c in zip(x["words"].as_py().split(b"\n"), B.widen(x["counts"].as_py()).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    first = sorted(total, key=lambda w: (-total[w], w))[:FREQUENT]
    return pa.table({"word": pa.array(first, pa.binary()), "n": pa.array([total[w] for w in first], pa.int64())})


def _neighbours(row: dict, frequent: dict[bytes, int], of: np.ndarray, buckets: int):
    """bucket, block, words, and of each its neighbours in training texts: cells of (class before, class behind, itself)."""
    block = B.Block(row)
    if not block.words:
        return
    classes = of[[unit_of(w, frequent) for w in block.words]]
    line, at, _ = _line(block, np.arange(len(block.words)) + 1)
    use = at[block.flags[block.owner]]
    told = np.concatenate([[0], classes])
    word, before, behind = line[use], line[use - 1], line[use + 1]
    width = 2 * CLASSES + 1
    cell = np.concatenate([(word - 1) * width + np.where(word == before, 2 * CLASSES, told[before]), ((word - 1) * width + CLASSES + told[behind])[word != behind]])
    cells, counts = np.unique(cell, return_counts=True)
    ends = np.searchsorted(cells, np.arange(len(block.words) + 1) * width)
    for bucket, places in _slices(block, buckets):
        sizes = ends[places + 1] - ends[places]
        which = np.repeat(ends[places] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        yield bucket, block.block, {"words": b"\n".join([block.words[i] for i in places.tolist()]), "sizes": B.narrow(sizes), "cells": (cells[which] % width).astype(np.uint8).tobytes(), "counts": B.narrow(counts[which])}


def _assign(table: pa.Table, frequent: dict[bytes, int], of: np.ndarray, moves: np.ndarray) -> pa.Table:
    """The answers to the blocks, counts and classes in their order of words, and the bucket's sums by class (block null).

    Every word is weighed against the same classes, so neither the order of words nor that of buckets matters.
    """
    numbers: dict[bytes, int] = {}
    width, keys, weights, asked = 2 * CLASSES + 1, [], [], []
    for x in table["asked"]:
        words = x["words"].as_py().split(b"\n")
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        asked.append(own)
        keys.append(np.repeat(own, B.widen(x["sizes"].as_py())) * width + np.frombuffer(x["cells"].as_py(), np.uint8))
        weights.append(B.widen(x["counts"].as_py()).astype(np.int64))
    cells, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place.ravel(), np.concatenate(weights), len(cells)).astype(np.int64)
    word, cell = cells // width, cells % width
    ends = np.searchsorted(word, np.arange(len(numbers) + 1))
    counts = np.zeros(len(numbers), np.int64)
    np.add.at(counts, word[(cell < CLASSES) | (cell == 2 * CLASSES)], n[(cell < CLASSES) | (cell == 2 * CLASSES)])
    classes, least = np.fromiter((of[unit_of(w, frequent)] for w in numbers), np.int64, len(numbers)), 1e-9 + LEAST_GAIN * float(xlogx(moves.sum()))
    # Words with the same neighbours are weighed once.
    kinds: dict[tuple, list[int]] = {}
    for i, w in enumerate(numbers):
        if counts[i] and w not in frequent:
            a, b = ends[i], ends[i + 1]
            kinds.setdefault((int(classes[i]), cell[a:b].tobytes(), n[a:b].tobytes()), []).append(i)
    told = list(kinds.values())
    for at in range(0, len(told), AT_ONCE):
        part = told[at : at + AT_ONCE]
        first = np.array([same[0] for same in part])
        sizes = ends[first + 1] - ends[first]
        which = np.repeat(ends[first] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        lines = np.zeros((len(part), width))
        lines[np.repeat(np.arange(len(part)), sizes), cell[which]] = n[which]
        new = best_classes(moves, classes[first], lines[:, CLASSES:-1], lines[:, :CLASSES], lines[:, -1], least)
        for same, c in zip(part, new.tolist(), strict=True):
            classes[same] = c
    answers = [B.narrow(counts[own] * 256 + classes[own]) if counts.max() < 1 << 24 else b"\0" + (counts[own] * 256 + classes[own]).tobytes() for own in asked]
    sums = [np.bincount(classes, counts, CLASSES).astype(np.int64), np.bincount(classes[counts == 1], minlength=CLASSES), [int((counts > 0).sum())]]
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
            "bucket": pa.array([table["bucket"][0].as_py()] * (len(asked) + 1), pa.int32()),
            "answer": pa.array([*answers, np.concatenate(sums).astype(np.int64).tobytes()], pa.binary()),
        }
    )


def _answered(row: dict, block: B.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and classes of the block's words."""
    found = np.zeros(len(block.words), np.int64)
    answers = {x["bucket"]: x["answer"] for x in row["answers"] or []}
    for bucket, at in _slices(block, buckets):
        answer = answers[bucket]
        found[at] = B.widen(answer) if answer[0] else np.frombuffer(answer, np.int64, offset=1)
    return found >> 8, found & 255


def _moves(batches, buckets: int):
    """Pairs of classes side by side in the training texts of a task."""
    sums = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for row in B.rows_of(batch):
            block = B.Block(row)
            line, _, doc = _line(block, _answered(row, block, buckets)[1])
            sums += np.bincount((line[:-1] * CLASSES + line[1:])[block.flags[doc]], minlength=CLASSES * CLASSES)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])


def _pairs(batches, frequent: dict[bytes, int]):
    """pair of units, count: over all training texts of a task."""
    size = 1 + FREQUENT + ENDINGS
    sums = np.zeros(size * size, np.int64)
    for batch in batches:
        for row in B.rows_of(batch):
            block = B.Block(row)
            if not block.flags.any():
                continue
            units = np.array([unit_of(w, frequent) for w in block.words] or [0], np.int64)
            line, _, doc = _line(block, units)
            keep = block.flags[doc]
            sums += np.bincount((line[:-1] * size + line[1:])[keep], minlength=size * size)
    at = np.flatnonzero(sums)
    for a in range(0, len(at), 100_000):
        part = at[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["pair", "n"])


def cluster(blocks: DataFrame, head: DataFrame) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The frequent words, the class of every unit, and pairs of classes; what comes to the driver is bounded by units and pairs of them."""
    frequent = {bytes(r["word"]): i + 1 for i, r in enumerate(head.orderBy(F.desc("n"), "word").limit(FREQUENT).collect())}
    size = 1 + FREQUENT + ENDINGS
    pairs = blocks.mapInArrow(lambda batches: _pairs(batches, frequent), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(size * size)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    del pairs
    bigrams = bigrams.reshape(size, size)
    of = exchange(bigrams)
    hot = np.zeros((size, CLASSES))
    hot[np.arange(size), of] = 1
    return frequent, of, hot.T @ bigrams @ hot


def learn(blocks: DataFrame, answered: DataFrame, sums: DataFrame, frequent: dict[bytes, int], of: np.ndarray, buckets: int) -> Model:
    """Sums by class; what comes to the driver is bounded by classes and buckets."""
    total = np.zeros(2 * CLASSES + 1, np.int64)
    for r in sums.toLocalIterator():
        total += np.frombuffer(r["answer"], np.int64)
    tokens, once, types = total[:CLASSES].astype(np.float64), total[CLASSES:-1].astype(np.float64), int(total[-1])
    ends = blocks.agg(F.sum(F.size(F.filter("flags", lambda x: x)))).first()[0] or 0
    tokens[0] = ends
    moves = np.zeros(CLASSES * CLASSES)
    for r in answered.mapInArrow(lambda batches: _moves(batches, buckets), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        moves[r["pair"]] = r["n"]
    moves = moves.reshape(CLASSES, CLASSES)
    share = (moves.sum(0) + 1) / (moves.sum() + CLASSES)
    transition = np.log10((moves + TRANSITION_PRIOR * share) / (moves.sum(1, keepdims=True) + TRANSITION_PRIOR))
    return Model(frequent, of, transition, tokens, once, int(tokens.sum()), types + (ends > 0), int(ends))


def _score(row: dict, model: Model, buckets: int):
    block = B.Block(row)
    counts, classes = _answered(row, block, buckets)
    docs = len(block.sizes)
    own = model.emission(counts, classes)
    each = lambda per_word: np.bincount(block.owner, per_word[block.codes], docs) if len(block.codes) else np.zeros(docs)
    line, _, doc = _line(block, classes)
    moved = np.bincount(doc, model.transition[line[:-1], line[1:]], docs)
    base = each(model.base(counts)) + log10((model.ends + 1) / (model.train_tokens + model.train_types + 1))
    known = each((counts > 0).astype(float)) + (model.ends > 0)
    score = moved + each(own) + model.end_emission()
    for i in range(docs):
        yield block.ids[i], bool(block.flags[i]), int(block.sizes[i]) + 1, int(known[i]), model.train_tokens, float(base[i]), float(score[i])


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model, int]:
    """Blocks of all rows with the training count and class of each word, the model of those rows where ``train`` holds, and the number of buckets."""
    importable(df.sparkSession)
    blocks = B.pack(df, id_col, text_col, train, lower=True)
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = B.buckets_for(words // 12)
    counts, cells = [("words", pa.binary()), ("counts", pa.binary())], [("words", pa.binary()), ("sizes", pa.binary()), ("cells", pa.binary()), ("counts", pa.binary())]

    def asking(ask, names, types):
        def run(batches):
            for batch in batches:
                for row in B.rows_of(batch):
                    for out in ask(row):  # an entry at a time: together they are as large as the block
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], names)

        return run

    asked = blocks.mapInArrow(asking(lambda row: _ask(row, buckets), ["bucket", "asked"], [pa.int32(), pa.struct(counts)]), "bucket int, asked struct<words:binary,counts:binary>")
    head = asked.groupBy("bucket").applyInArrow(_count, "word binary, n bigint")
    frequent, of, moves = cluster(blocks, head)
    near = blocks.mapInArrow(
        asking(lambda row: _neighbours(row, frequent, of, buckets), ["bucket", "block", "asked"], [pa.int32(), pa.int64(), pa.struct(cells)]),
        "bucket int, block bigint, asked struct<words:binary,sizes:binary,cells:binary,counts:binary>",
    )
    assigned = stored(near.groupBy("bucket").applyInArrow(lambda table: _assign(table, frequent, of, moves), "block bigint, bucket int, answer binary"))
    answered = stored(B.with_answers(blocks, assigned.where(F.col("block").isNotNull())))
    return answered, learn(blocks, answered, assigned.where(F.col("block").isNull()), frequent, of, buckets), buckets


def fit_and_score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score, score (both log10), of every row; learns where ``train`` holds."""
    answered, model, buckets = fit(df, train, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches):
        for batch in batches:
            for row in B.rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*_score(row, sent.value, buckets), strict=True), types, strict=True)], names)

    return answered.mapInArrow(score, "id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
