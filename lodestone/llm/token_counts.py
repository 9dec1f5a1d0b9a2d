"""Operator 6: the exact token count of every prefix of a text, by dynamic programming over prefixes.

For a byte-level BPE with ranked merges, a row of tokens is the encoding of its bytes exactly when each pair of
neighbours is the encoding of the pair's own bytes. So the encoding of a prefix ends in the one token that is a suffix
of it and agrees with the last token of the rest: count[i] = count[i - len(token)] + 1. The counts of every prefix,
kept as differences, answer how long a text is, where it reaches a budget, and what a cut costs, without encoding again.

Where a prefix is cut otherwise than the whole text - in a run of white space before a word, in an English
contraction, in the written form of a special token - the differences account for it.

Nulls count as empty texts (0 tokens, no differences). Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
from operator import sub
from pathlib import Path
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.byte_bpe import byte_alphabet
from lodestone.llm.common import map_rows, texts_of

#: Cached units and pairs of a task; beyond it a cache starts anew.
CACHE = 400_000


def read_merges(path: str) -> dict:
    """What the counts need of a byte-level tokenizer.json: merges in order, special strings."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    before, model = spec["pre_tokenizer"], spec["model"]
    if before["type"] != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model["type"] != "BPE":
        raise ValueError("only plain byte-level BPE files")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("special tokens must match their plain text")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"]]}


class _Units(dict):
    """Differences of units seen before."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        made = self.make(unit)
        if len(unit) <= 64:
            self[unit] = made
        return made


class PrefixCounts:
    """Differences of the token count from each prefix to the next longer one, a code point at a time."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str], pattern: str):
        byte = {ch: bytes([b]) for b, ch in enumerate(byte_alphabet())}
        text = lambda s: b"".join(byte[ch] for ch in s)
        self.id = {bytes([b]): b for b in range(256)}
        #: Of each token the rank of the merge that makes it and its two halves; single bytes are made by none.
        self.made, self.left, self.right = [-1] * 256, list(range(256)), list(range(256))
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate((text(a), text(b)) for a, b in merges):
            left, right = self.id[a], self.id[b]
            if a + b not in self.id:
                self.id[a + b] = len(self.made)
                self.made.append(rank)
                self.left.append(left)
                self.right.append(right)
            self.rank[left << 20 | right] = rank
        self.matcher = ahocorasick.Automaton()
        for token, number in self.id.items():
            self.matcher.add_word(token.decode("latin-1"), (number, len(token)))
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = _Units(self._differences)
        # A unit is a match of the pattern, or a run of white space with the match behind it: the look-ahead gives the run's last blank away once the word begins.
        word = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(rf"\s{{2,}}(?=\S)(?:(?<= )(?:{word})|(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d|{word}))|{pattern}").findall
        self.parts = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def agrees(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are side by side.

        Going back in time, the later of the two merges that made the tokens at the boundary is undone. Until then the
        two stood there together: had they a merge of their own with a smaller rank, it would have come first. Of
        equal ranks the one further left comes first.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        rank, made = self.rank, self.made
        until = 1 << 30
        while True:
            if rank.get(left << 20 | right, 1 << 30) < until:
                known = False
                break
            if made[left] < 0 and made[right] < 0:
                known = True
                break
            if made[left] > made[right]:
                until, left = made[left], self.right[left]
            else:
                until, right = made[right] + 1, self.left[right]
        self.pairs[key] = known
        return known

    def of_part(self, part: str) -> list[int]:
        """count[i] for every prefix of one pre-token, whose bytes are given as the characters of the same numbers."""
        pairs, agrees = self.pairs.get, self.agrees
        count, last, done = [0] * (len(part) + 1), [-1] * (len(part) + 1), 0
        for at, (token, length) in self.matcher.iter(part):
            if at < done:
                continue
            start = at + 1 - length
            if start:
                known = pairs(last[start] << 20 | token)
                if known is None:
                    known = agrees(last[start], token)
                if not known:
                    continue
            done = at + 1
            count[done] = count[start] + 1
            last[done] = token
        return count

    def _differences(self, unit: str) -> bytes:
        blank = len(unit) - len(unit.lstrip())
        if 1 < blank < len(unit):  # a prefix within the run is one match; once the word begins, the run ends a blank earlier
            counts = self._of_chars(unit[:blank])
            rest = self._of_chars(unit[blank - 1 :]) if unit[blank - 1] == " " else [n + self._of_chars(unit[blank - 1])[0] for n in [0, *self._of_word(unit[blank:])]]
            counts += [counts[blank - 2] + n for n in rest[1:]]
        else:
            counts = self._of_word(unit)
        return pack(f"<{len(counts)}h", *map(sub, counts, [0, *counts[:-1]]))

    def _of_word(self, word: str) -> list[int]:
        if word[0] == "'" and 1 < len(word) <= 3:  # a contraction's prefixes are cut in two
            return [sum(self._of_chars(p)[-1] for p in self.parts(word[:end])) for end in range(1, len(word) + 1)]
        return self._of_chars(word)

    def _of_chars(self, part: str) -> list[int]:
        if part.isascii():
            return self.of_part(part)[1:]
        count = self.of_part(part.encode().decode("latin-1"))
        ends, at = [], 0
        for ch in part:
            at += len(ch.encode())
            ends.append(at)
        return [count[e] for e in ends]

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self.split(text)))

    def differences(self, text: str) -> bytes:
        """Two bytes a code point: the change of the token count when the prefix takes it in."""
        if not text or self.special is None or not self.special.search(text):
            return self.ordinary(text or "")
        out, at = [], 0
        for hit in self.special.finditer(text):
            body, mark = text[at : hit.start()], hit.group()
            steps = np.frombuffer(self.ordinary(body + mark[:-1]), "<i2")
            whole = np.frombuffer(self.ordinary(body), "<i2").sum() + 1
            out += [steps.tobytes(), np.array([whole - steps.sum()], "<i2").tobytes()]
            at = hit.end()
        return b"".join([*out, self.ordinary(text[at:])])


def total(differences: bytes) -> int:
    return int(np.frombuffer(differences, "<i2").sum(dtype=np.int64))


def at_prefix(differences: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points."""
    return int(np.frombuffer(differences, "<i2")[:n_chars].sum(dtype=np.int64))


def longest_prefix(differences: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most so many tokens."""
    counts = np.concatenate([[0], np.frombuffer(differences, "<i2").cumsum(dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(df: DataFrame, path: str, pattern: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text", differences: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, cut (code points of the longest prefix within the budget), and, if wanted, differences (binary)."""
    spec = read_merges(path)

    def start():
        counter = _counter(spec, pattern)
        return lambda batch: _counted(counter, batch, budget, differences)

    rows = texts_of(df, id_col, text_col)
    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, cut bigint" + ", differences binary" * differences)


_counters: dict[tuple, PrefixCounts] = {}


def _counter(spec: dict, pattern: str) -> PrefixCounts:
    """One for each worker process, whose tasks share its caches."""
    key = (len(spec["merges"]), hash(tuple(spec["merges"])), tuple(spec["special"]), pattern)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounts(spec["merges"], spec["special"], pattern)
    return _counters[key]


def _counted(counter: PrefixCounts, batch: pa.RecordBatch, budget: int, differences: bool) -> pa.RecordBatch:
    sizes, totals, cuts, kept = [], [], [], []
    for value in batch["text"]:
        text = value.as_py() or ""
        steps = counter.differences(text)
        sizes.append(len(text.encode()))
        totals.append(total(steps))
        cuts.append(len(text) if len(text) <= budget // 4 else longest_prefix(steps, budget))
        if differences:
            kept.append(steps)
    columns = [batch["id"], *(pa.array(x, pa.int64()) for x in (sizes, totals, cuts)), *([pa.array(kept, pa.binary())] if differences else [])]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "cut", "differences"][: len(columns)])
