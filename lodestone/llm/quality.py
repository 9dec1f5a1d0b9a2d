"""Operator 5: quality rules as a short-circuit cascade.

Every rule is a predicate on a text that says why it should go. On a bounded sample each rule is run on its own, its
cost and its share of rejections are measured, and the rules are put in order of rejections per cost; the cascade then
stops at the first rule that rejects. A rejected text is rejected in any order, so the verdict does not depend on the
measurement; the time does, and which of several failed rules is named.

Nulls and empty texts have no words and are rejected as too short. Repeated rows give repeated results; other columns
are not read.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_rows, texts_of

#: Rows of the sample on which costs and selectivities are measured, about.
SAMPLE_ROWS = 1000
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"


class Text:
    """A text's features, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words within windows of eight that the text has twice or more; windows are told apart exactly, by doubling."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, self.n_words)
        width = 1
        while width < WINDOW:
            top = int(ids.max()) + 1
            _, ids = np.unique(ids[:-width] * top + ids[width:], return_inverse=True)
            width *= 2
        again = np.bincount(ids)[ids] > 1
        if not again.any():
            return 0
        edges = np.zeros(self.n_words + 1, np.int64)
        starts = np.flatnonzero(again)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int((edges.cumsum() > 0).sum())

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: What rejects a text. The bounds are wide: ordinary prose in any language passes all of them.
RULES = {
    "few_words": lambda t: t.n_words < MIN_WORDS,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 8 * t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 5 * len(t.lines),
    "few_letters": lambda t: 2 * t.letters < t.word_chars,
}


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """For every rule its mean cost in nanoseconds, features included, and its share of rejections on the sample."""
    rows = texts_of(df, id_col, text_col)
    share = min(1.0, 2 * sample_rows / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample_rows)

    def start():
        def timed(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, spent, hits = [], [], []
            for value in batch["text"]:
                for name, rule in rules.items():
                    text = Text(value.as_py())
                    began = time.perf_counter_ns()
                    hit = bool(rule(text))
                    names.append(name)
                    spent.append(time.perf_counter_ns() - began)
                    hits.append(int(hit))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(spent, pa.int64()), pa.array(hits, pa.int64())], ["rule", "ns", "hit"])

        return timed

    found = map_rows(picked, start, "rule string, ns bigint, hit bigint").groupBy("rule").agg(F.avg("ns").alias("ns"), F.avg("hit").alias("hit"))
    return {r["rule"]: (r["ns"], r["hit"]) for r in found.collect()}


def plan(measured: dict[str, tuple[float, float]], rules: dict = RULES) -> list[str]:
    """Rules in order of rejections per cost. A rule that was not measured comes last, ties go by name."""
    return sorted(rules, key=lambda r: (-(measured[r][1] / max(1.0, measured[r][0])) if r in measured else 1.0, measured.get(r, (1e18,))[0], r))


def first_failure(text: Text, order: list[str], rules: dict = RULES) -> str | None:
    return next((name for name in order if rules[name](text)), None)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, order: list[str] | None = None) -> DataFrame:
    """id, kept, failed_rule (the first in the cascade's order), and the features of the base rules, of every whole text."""
    order = order or plan(measure(df, id_col, text_col, rules), rules)
    rows = texts_of(df, id_col, text_col)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            failed, base, features = [], [], {c: [] for c in counts}
            for value in batch["text"]:
                text = Text(value.as_py())
                failed.append(first_failure(text, order, rules))
                for c in counts:
                    features[c].append(getattr(text, c))
                base.append(text.base_failed)
            kept = [f is None for f in failed]
            return pa.RecordBatch.from_arrays(
                [batch["id"], *(pa.array(features[c], pa.int64()) for c in counts), pa.array(base), pa.array(kept), pa.array(failed, pa.string())],
                ["id", *counts, "base_failed", "kept", "failed_rule"],
            )

        return apply

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, kept boolean, failed_rule string")
