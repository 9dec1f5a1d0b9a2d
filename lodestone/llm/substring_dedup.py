"""Operator 7: words of repeated passages, found through difference-cover anchors.

Positions p of a document with p mod 13 in {0, 1, 3, 9} form a difference cover: for any two starts there is one shift
below 13 that takes both to cover positions. So of two equal windows of 20 words, the anchors of 8 words at some common
shift are equal too, and only anchors at cover positions need be hashed and exchanged. Windows around anchors that the
corpus has twice are then extended to 20 words and settled by a 128-bit key of all of them (two sums of 64-bit hashes of
the words): the first occurrence, by document id and position, stays, and the words of every later one go.

Exchanges carry each anchor and each window once a block, so a passage that a third of all documents share puts one
entry a block into its bucket, not one a document; nothing is paired within a group. Sorting aside, the work is linear
in words and entries.

Ids are integers. Nulls and texts of fewer than 20 words lose nothing. Null ids count as one document behind all others. Rows that repeat
an id count as one document: windows at the same position of both don't remove each other. Words are kept unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import blocks as B
from lodestone.llm.common import stored
from lodestone.session import importable

WINDOW = 20
PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOD = 1 << 64


def rolling(h: np.ndarray, width: int, by: int) -> np.ndarray:
    """A polynomial hash of ``width`` entries from each position on; what reaches beyond the end is meaningless."""
    out, done, piece, size = np.zeros(len(h), np.uint64), 0, h.copy(), 1
    while width:
        if width & 1:
            out[: max(0, len(h) - done)] += piece[done:] * np.uint64(pow(by, done, MOD))
            done += size
        width >>= 1
        if width:
            longer = piece.copy()
            longer[: max(0, len(h) - size)] += piece[size:] * np.uint64(pow(by, size, MOD))
            piece, size = longer, 2 * size
    return out


class Passages(B.Block):
    def __init__(self, row: dict):
        super().__init__(row)
        self.hash = B.digests(self.words)[self.codes] if self.words else np.zeros((0, 2), np.uint64)
        self.place = np.arange(len(self.codes)) - self.starts[self.owner] if len(self.codes) else np.zeros(0, np.int64)
        self.room = self.sizes[self.owner] - self.place if len(self.codes) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat positions of the anchors that windows can have, and their hashes."""
        covered = np.isin(np.arange(PERIOD), COVER)
        at = np.flatnonzero(covered[self.place % PERIOD] & (self.room >= ANCHOR) & (self.sizes[self.owner] >= WINDOW)) if len(self.codes) else np.zeros(0, np.int64)
        return at, rolling(np.ascontiguousarray(self.hash[:, 0]), ANCHOR, MULTIPLIERS[0])[at]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows around repeated anchors, whose flat positions are given."""
        seen = np.zeros(len(self.codes) + PERIOD + 1, np.int64)
        seen[repeated + 1] = 1
        seen = seen.cumsum()
        starts = np.flatnonzero(self.room >= WINDOW)
        return starts[seen[starts + PERIOD] > seen[starts]]

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = rolling(np.ascontiguousarray(self.hash[:, 0]), WINDOW, MULTIPLIERS[0])[starts]
        two = rolling(np.ascontiguousarray(self.hash[:, 1]), WINDOW, MULTIPLIERS[1])[starts]
        return one, two


def _ask_anchors(row: dict, buckets: int):
    """bucket, block, hashes: each distinct anchor of the block once."""
    passages = Passages(row)
    known = np.unique(passages.anchors()[1])
    for bucket, a, b in B.slices(known, buckets):
        yield bucket, passages.block, known[a:b].tobytes()


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For every block bits in the order of its hashes: does another block have the anchor?"""
    asked = [np.frombuffer(x.as_py(), "<u8") for x in table["asked"]]
    every = np.concatenate(asked)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(list(map(len, asked)))[:-1])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(bits, pa.binary())})


def _ask_windows(row: dict, buckets: int):
    """bucket, block, packed: candidate windows by key, the first of equal ones in the block; later ones as already lost."""
    passages = Passages(row)
    at, hashes = passages.anchors()
    known, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = times > 1
    answers = {x["bucket"]: x["answer"] for x in row["answers"] or ()}
    for bucket, a, b in B.slices(known, buckets):
        if bucket in answers:
            repeated[a:b] |= np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).astype(bool)
    starts = passages.candidates(at[repeated[place]])
    if not len(starts):
        return
    one, two = passages.keys(starts)
    ids = np.array([B.NO_ID if x is None else x for x in passages.ids], np.int64)
    doc, pos = ids[passages.owner[starts]], passages.place[starts]
    order = np.lexsort((pos, doc, two, one))
    starts, one, two, doc, pos = starts[order], one[order], two[order], doc[order], pos[order]
    first, lost = _later(one, two, doc, pos)
    for bucket, a, b in B.slices(one, buckets):
        own = first[a:b]
        f = starts[a:b][own]
        docs = np.unique(passages.owner[f])
        yield bucket, passages.block, {
            "one": one[a:b][own].tobytes(), "two": two[a:b][own].tobytes(), "flat": B.narrow(f), "lost": B.narrow(np.sort(starts[a:b][lost[a:b]])),
            "docs": ids[docs].tobytes(), "begins": B.narrow(passages.starts[docs]),
        }


def _later(one, two, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by key, document and position: which is the first of its key in the block, which comes after another."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
    lost = (doc > doc[head]) | (doc == doc[head]) & (pos > pos[head])
    return ~lost, lost


def _answer_windows(table: pa.Table) -> pa.Table:
    """For every block the starts of its windows that are not the first of the corpus."""
    asked = table["asked"].to_pylist()
    one = np.concatenate([np.frombuffer(x["one"], "<u8") for x in asked])
    two = np.concatenate([np.frombuffer(x["two"], "<u8") for x in asked])
    doc, pos, flat, block = [], [], [], []
    for i, x in enumerate(asked):
        f, begins, docs = B.widen(x["flat"]).astype(np.int64), B.widen(x["begins"]).astype(np.int64), np.frombuffer(x["docs"], np.int64)
        which = np.searchsorted(begins, f, side="right") - 1
        doc.append(docs[which])
        pos.append(f - begins[which])
        flat.append(f)
        block.append(np.full(len(f), i))
    doc, pos, flat, block = map(np.concatenate, (doc, pos, flat, block))
    order = np.lexsort((pos, doc, two, one))
    _, lost = _later(one[order], two[order], doc[order], pos[order])
    flat, block = flat[order][lost], block[order][lost]
    by_block = np.lexsort((flat, block))
    each = np.split(flat[by_block], np.cumsum(np.bincount(block, minlength=len(asked)))[:-1])
    answers = [B.narrow(np.sort(np.concatenate([own, B.widen(x["lost"]).astype(np.int64)]))) for own, x in zip(each, asked, strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})


def _settle(row: dict):
    """id, n_words, removed (word positions, ends exclusive), kept text: for every document of the block."""
    block = B.Block(row)
    edges = np.zeros(len(block.codes) + 1, np.int64)
    for x in row["answers"] or ():
        lost = B.widen(x["answer"]).astype(np.int64)
        np.add.at(edges, lost, 1)
        np.add.at(edges, lost + WINDOW, -1)
    gone = edges[:-1].cumsum() > 0
    for i, number in enumerate(block.ids):
        a, b = int(block.starts[i]), int(block.starts[i] + block.sizes[i])
        out = gone[a:b]
        yield number, b - a, int(out.sum()), b" ".join([block.words[c] for c in block.codes[a:b][~out].tolist()])


WINDOWS = "struct<one:binary,two:binary,flat:binary,lost:binary,docs:binary,begins:binary>"
ANSWER = "block bigint, bucket int, answer binary"


def _mapped(df: DataFrame, make, schema: str, types: list) -> DataFrame:
    """Rows out of each block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in B.rows_of(batch):
                out = list(make(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return df.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (binary: the kept words joined by one blank), for every row."""
    importable(df.sparkSession)
    blocks = B.pack(df, id_col, text_col)
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = B.buckets_for(words * len(COVER) // PERIOD)
    small = [pa.int32(), pa.int64(), pa.binary()]
    asked = _mapped(blocks, lambda row: _ask_anchors(row, buckets), "bucket int, block bigint, asked binary", small)
    repeated = stored(asked.groupBy("bucket").applyInArrow(_answer_anchors, ANSWER))
    fields = pa.struct([(x, pa.binary()) for x in ("one", "two", "flat", "lost", "docs", "begins")])
    windows = _mapped(B.with_answers(blocks, repeated), lambda row: _ask_windows(row, buckets), f"bucket int, block bigint, asked {WINDOWS}", [pa.int32(), pa.int64(), fields])
    lost = stored(windows.groupBy("bucket").applyInArrow(_answer_windows, ANSWER))
    return _mapped(B.with_answers(blocks, lost), _settle, "id bigint, n_words bigint, n_removed bigint, kept binary", [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
