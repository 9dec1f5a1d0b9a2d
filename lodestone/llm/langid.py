"""Operator 2: language identification by cross-parsing entropy.

A suffix automaton of each language's learning text finds, from any place in a text, the longest piece that the
learning text also has. Parsing a text into such pieces needs few of them in its own language: phrases * log2(learning
length) / length estimates the cross entropy, and the least wins.

Texts are lower-cased, runs of what is no letter become one blank, and letters that no learning text has end a phrase.
The automata are walked in step by many segments of whole texts at once. Every segment is first walked as if it began
the text; then those that follow another are walked again from the state in which that one ended, only until both walks
begin a phrase at the same place, from where on they are the same. So the phrases are those of the whole text, however
it is cut. Transitions by the most frequent letters are dense tables, those by all other letters of the learning texts a
hash table.

The learning sample is whole documents, picked by a hash of id and text, as many as its documented bounds let in; a
language whose documents are all longer than the bound has its shortest one, and no more of it than ALONE times the bound.
Beyond LANGUAGES labels the most frequent ones are learnt. So the sample has ALONE * ALL_CHARS characters at the very most.

A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from. Ties
go to the first language by name. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from math import log2
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_bucket, map_rows

#: Bounds of the learning sample: characters a language, characters in all, documents a language, languages.
LANGUAGE_CHARS, ALL_CHARS, LANGUAGE_DOCS, LANGUAGES = 24_000, 480_000, 160, 400
#: Times its characters that a language's only document may have.
ALONE = 5
#: Learning texts that are shorter count as so long, as phrases of a few words say nothing.
LEAST_LENGTH = 1024
#: Letters with a column of the dense tables; the others' transitions are hashed.
LETTERS = 120
#: Code points of a segment, of the segments walked at once, and of a stride of those that are walked again.
SEGMENT, AT_ONCE, STRIDE = 1024, 1_500_000, 32


def normal(text: str) -> str:
    return " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every suffix; state 0 is the root."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class Hashed:
    """Numbers by whole keys of 0 or more, looked up many at once; a quarter of the slots is taken at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = 64 - max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.zeros(len(self.keys), np.int32)
        slots = self.slots(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], self.after(slots[rest])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def after(self, slots: np.ndarray) -> np.ndarray:
        return slots + 1 & len(self.keys) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        found, slots, at = np.full(len(keys), -1, np.int32), self.slots(keys), np.arange(len(keys))
        while len(at):
            there = self.keys[slots]
            hit = there == keys[at]
            found[at[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            at, slots = at[more], self.after(slots[more])
        return found


class CrossParser:
    """Tables of all languages; a step gives the next state and whether a phrase began.

    Codes: 0 the blank, then letters by frequency, of which those from ``rare`` on are hashed, then ``other``.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = {lang: normal(samples[lang]) for lang in self.languages}
        counts: dict[str, int] = {}
        for text in texts.values():
            for ch in text:
                counts[ch] = counts.get(ch, 0) + 1
        counts.pop(" ", None)
        alphabet = sorted(counts, key=lambda ch: (-counts[ch], ch))
        self.code = {" ": 0} | {ch: i + 1 for i, ch in enumerate(alphabet)}
        self.other = len(self.code)
        self.rare = min(self.other, LETTERS + 1)
        self.width = self.rare + 1
        tables, starts, keys, values, at = [], [], [], [], 0
        for lang in self.languages:
            edges = suffix_automaton([self.code[ch] for ch in texts[lang]])
            n = len(edges)
            root = np.full(self.width, at * 2 + 1, np.int32)  # a letter that no text has is a phrase of its own
            for c, q in edges[0].items():
                if c < self.rare:
                    root[c] = (at + q) * 2 + 1
            table = np.tile(root, (n, 1))
            for p in range(n):
                for c, q in edges[p].items():
                    if c >= self.rare:
                        keys.append((at + p) * self.other + c)
                        values.append(at + q)
                    elif p:
                        table[p, c] = (at + q) * 2
            tables.append(table)
            starts.append(at)
            at += n
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.starts = np.array(starts, np.int32)
        self.hashed = Hashed(np.array(keys, np.int64), np.array(values, np.int32))
        self.bits = np.array([log2(max(LEAST_LENGTH, len(texts[lang]))) for lang in self.languages])

    def by_rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Twice the next state, plus 1 where a phrase began, by (languages, texts) states and the texts' rare codes."""
        starts = np.repeat(self.starts[:, None], len(codes), axis=1).ravel()
        codes = np.tile(codes.astype(np.int64), len(self.starts))
        state = state.ravel()
        found = self.hashed.get(state * np.int64(self.other) + codes)
        began = (found < 0) | (state == starts)
        again = np.flatnonzero(found < 0)
        root = self.hashed.get(starts[again] * np.int64(self.other) + codes[again])
        found[again] = np.where(root < 0, starts[again], root)
        return (found * 2 + began).reshape(len(self.starts), -1)

    def classes(self) -> np.ndarray:
        """For every code point its code: 0 for what is no letter."""
        found = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                found[cp] = self.other
        for ch, code in self.code.items():
            found[ord(ch)] = code
        return found


def _longer(sizes: np.ndarray, most: int) -> np.ndarray:
    """For each of so many steps the number of lanes, which are in falling order of size, that are longer."""
    return np.searchsorted(-sizes, -np.arange(min(int(sizes.max()), most)), side="left")


class Predictor:
    def __init__(self, parser: CrossParser):
        self.parser, self.classes = parser, parser.classes()

    def codes(self, text: str) -> np.ndarray:
        codes = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0  # the first of a run of blanks stays
        return codes[keep]

    def walk(self, steps: np.ndarray, active: np.ndarray, state: np.ndarray, began: np.ndarray) -> None:
        """Moves the lanes' states over their codes and notes where phrases begin, in (steps, languages, lanes)."""
        parser = self.parser
        rare = (steps >= parser.rare) & (steps < parser.other)
        hashed, dense = rare.any(1), np.minimum(steps, parser.rare)
        for step, n in enumerate(active):
            moved = parser.table[state[:, :n] * parser.width + dense[step, :n]]
            if hashed[step]:
                lanes = np.flatnonzero(rare[step, :n])
                moved[:, lanes] = parser.by_rare(state[:, lanes], steps[step, lanes])
            began[step, :, :n] = moved & 1
            state[:, :n] = moved >> 1

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases that each text takes."""
        parser, total = self.parser, np.zeros((len(rows), len(self.parser.languages)), np.int64)
        owner, pieces = [], []
        for i, codes in enumerate(rows):
            for at in range(0, len(codes), SEGMENT):
                owner.append(i)
                pieces.append(codes[at : at + SEGMENT])
        if not pieces:
            return total
        owner, sizes = np.array(owner), np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        lane_of = np.empty(len(order), np.int64)
        lane_of[order] = np.arange(len(order))
        steps = np.zeros((sizes.max(), len(pieces)), np.int32)
        for lane, i in enumerate(order):
            steps[: sizes[i], lane] = pieces[i]
        length = sizes[order]
        state = np.repeat(parser.starts[:, None], len(pieces), axis=1)
        began = np.zeros((len(steps), *state.shape), bool)
        self.walk(steps, _longer(length, len(steps)), state, began)
        # Lanes whose segment follows another of the same text, and the lane of that one.
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        after, before = lane_of[later], lane_of[later - 1]
        entered = np.repeat(parser.starts[:, None], len(pieces), axis=1)  # where each lane's last walk began
        while len(after):
            new = (state[:, before] != entered[:, after]).any(0)
            todo, first = after[new], state[:, before[new]]
            if not len(todo):
                break
            by_size = np.argsort(-length[todo], kind="stable")
            todo, now = todo[by_size], np.ascontiguousarray(first[:, by_size])
            entered[:, todo] = now
            self._again(steps, length, todo, now, state, began)
        np.add.at(total, owner[order], began.sum(0).T)
        return total

    def _again(self, steps: np.ndarray, length: np.ndarray, lanes: np.ndarray, now: np.ndarray, state: np.ndarray, began: np.ndarray) -> None:
        """Walks the lanes from the states ``now``, some steps at a time and each until it meets its last walk, and mends their notes.

        Last states are mended where the walks stay apart to the end.
        """
        apart, at = np.ones(now.shape, bool), 0
        while len(lanes):
            part = np.ascontiguousarray(steps[at : at + STRIDE, lanes])
            new = np.zeros((len(part), *now.shape), bool)
            self.walk(part, _longer(length[lanes] - at, len(part)), now, new)
            old = began[at : at + STRIDE, :, lanes]
            both = old & new
            met = both.any(0)
            upto = np.where(apart, np.where(met, both.argmax(0), len(part)), 0)  # what is new
            began[at : at + STRIDE, :, lanes] = np.where(np.arange(len(part))[:, None, None] < upto, new, old)
            apart &= ~met
            at += STRIDE
            ended = length[lanes] <= at
            state[:, lanes[ended]] = np.where(apart[:, ended], now[:, ended], state[:, lanes[ended]])
            left = apart.any(0) & ~ended
            lanes, now, apart = lanes[left], np.ascontiguousarray(now[:, left]), apart[:, left]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[float]]]:
        """Language, score, and the bits a character of every language."""
        langs, scores, costs = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
        at, rows, size = [], [], 0
        if not self.parser.languages:
            return langs, scores, costs

        def settle():
            found = self.phrases(rows)
            for i, codes, counts in zip(at, rows, found, strict=True):
                bits = counts * self.parser.bits
                best = int(bits.argmin())
                weights = np.exp2(np.maximum(-60.0, (bits.min() - bits) / 8))
                langs[i], scores[i], costs[i] = self.parser.languages[best], float(weights[best] / weights.sum()), (bits / len(codes)).tolist()

        for i, text in enumerate(texts):
            codes = self.codes(text) if text else np.zeros(0, np.int32)
            if codes.any():
                at.append(i)
                rows.append(codes)
                size += len(codes)
                if size >= AT_ONCE:
                    settle()
                    at, rows, size = [], [], 0
        settle()
        return langs, scores, costs


def learning_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> dict[str, str]:
    """A bounded sample of labelled documents outside the held-out fold: whole ones, in order of a hash, as long as they fit. A language without any has its shortest, up to a bound."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("id"), folds) != 0))
    rows = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("id", "text"), 1))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: max(1, r["n"]) for r in counted.collect()}
    if not counts:
        return {}
    docs, chars = max(1, min(LANGUAGE_DOCS, 16 * LANGUAGE_DOCS // len(counts))), max(1, min(LANGUAGE_CHARS, ALL_CHARS // len(counts)))
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 3 * docs / n) * (1 << 62)) * 2 - 1)])
    near = rows.where(F.col("key") <= limits[F.col("lang")]).groupBy("lang", "key").agg(F.min(F.length("text")).alias("size"))
    # Some three times as many distinct documents as are wanted, by their hashes and sizes.
    at_hand: dict[str, list[tuple[int, int]]] = {}
    for r in near.toLocalIterator():
        at_hand.setdefault(r["lang"], []).append((r["key"], r["size"]))
    chosen: dict[int, None] = {}
    for found in at_hand.values():
        room, picked = chars, []
        for key, size in sorted(found):
            if size <= room and len(picked) < docs:
                picked.append(key)
                room -= size
        chosen |= dict.fromkeys(picked or [min(found, key=lambda x: (x[1], x[0]))[0]])
    own = rows.where(F.col("key").isin(list(chosen)) & F.col("lang").isin(list(counts))).select("lang", "key", F.substring("text", 1, ALONE * chars).alias("text"))
    texts = own.groupBy("lang", "key").agg(F.min("text").alias("text")).orderBy("lang", "key")
    samples: dict[str, list[str]] = {}
    for r in texts.toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"])
    joined = {lang: "\n".join(parts) for lang, parts in samples.items()}
    return {lang: text for lang, text in joined.items() if normal(text)}


def learn(df: DataFrame, **names) -> CrossParser:
    return CrossParser(learning_sample(df, **names))


_held: tuple[str, Predictor] | None = None


def _predictor(model: str, sent) -> Predictor:
    """One for each worker process, as long as the model is the same."""
    global _held
    if _held is None or _held[0] != model:
        _held = (model, Predictor(sent.value))
    return _held[1]


def predict(df: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the input's id as ``id``, lang_pred, score, and bits: the cross entropy of each language by name."""
    sent, model = df.sparkSession.sparkContext.broadcast(parser), uuid4().hex  # its size is bounded by that of the learning sample
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores, bits = _predictor(model, sent).predict(batch["text"].to_pylist())
            return pa.RecordBatch.from_arrays([batch["id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.list_(pa.float64()))], ["id", "lang_pred", "score", "bits"])

        return apply

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, bits array<double>")


def keep_identified(df: DataFrame, parser: CrossParser, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, with it as their label where they have none; what is ``und`` goes.

    Labels that are there stay, and so do all other columns. With nothing to learn from no text has a language, and
    those with a letter stay as they are.
    """
    sent, model = df.sparkSession.sparkContext.broadcast(parser), uuid4().hex
    at = df.columns.index(lang_col)

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch[text_col].to_pylist()
            if not sent.value.languages:
                return batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
            langs, _, _ = _predictor(model, sent).predict(texts)
            columns = list(batch.columns)
            columns[at] = pc.coalesce(columns[at], pa.array(langs, columns[at].type))
            return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array([lang != "und" for lang in langs], pa.bool_()))

        return apply

    return map_rows(df, start, df.schema)
