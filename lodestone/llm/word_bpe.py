"""Operator 12: BPE with word ends, encoded over a trie of distinct words.

A row of tokens is the encoding of its symbols exactly when each pair of neighbours stays as it is side by side. So the
encoding of a prefix ends in one token: a suffix of the prefix that agrees with the last token of what stands before it.
Distinct words go into a trie in sorted order, which visits it depth first; a node's state is its place in an automaton of
all tokens, its last token, and the node where that token begins. What words share is encoded once, and a word's ids are
read off by walking back. A word's last letter is a symbol of its own, so words part at their ends only.

Texts are cut at special strings, then normalised (canonical composition, lower case) and split by the vocabulary's
pattern. Texts with code points that this Python's tables don't know are normalised and split by the tokenizers library's
own parts, whose tables are of another version. Decoding joins the tokens' written forms by blanks, as the library does
for a file without decoder.

Nulls count as empty texts (no tokens, hashes of nothing). Repeated rows give repeated results; other columns are not
read. A word of any length costs time in proportion to it; words beyond LONG bytes get a path that isn't kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Callable, Iterable
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestone.llm.byte_bpe import byte_alphabet
from lodestone.llm.common import map_rows, texts_of
from lodestone.llm.token_counts import PrefixCounts

#: Nodes of a task's trie and cached words; beyond either, both start anew.
NODES, WORDS = 1_000_000, 400_000
#: Bytes beyond which a word is not worth sharing.
LONG = 64
#: What Python's split takes for white space and the pattern does not.
ODD = re.compile("[\x1c-\x1f]").search


class Merges:
    """A vocabulary: which token each merge makes, and an automaton that finds all tokens that end at a symbol.

    Symbols are the ids of the 256 bytes, and of the 256 bytes that end a word.
    """

    agrees = PrefixCounts.agrees  # the rule for two neighbours asks for merges only

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = (split["behavior"], split["invert"], byte_level["add_prefix_space"], byte_level["use_regex"]) == ("Removed", True, False, False)
        if model["type"] != "BPE" or model.get("ignore_merges") or not plain or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only byte-level BPE files with word ends, composed and lower-cased, without decoder")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must match their plain text")
        self.file = json.dumps({**spec, "model": {**model, "vocab": {}, "merges": []}, "added_tokens": []})
        self.pattern, end = split["pattern"]["Regex"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for piece, number in [*vocab.items(), *self.special.items()]:
            self.pieces[number] = piece
        letters = byte_alphabet()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        symbols: list[tuple[int, ...] | None] = [None] * size
        for number in (*self.inner, *self.last):
            symbols[number] = (number,)
        self.made, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.rank: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if symbols[made] is not None:
                raise ValueError(f"more than one merge makes {a + b}")
            self.rank[left << 20 | right] = rank
            symbols[made] = symbols[left] + symbols[right]
            self.made[made], self.left[made], self.right[made] = rank, left, right
        # a token that the merges before its own keep from being made is no encoding of anything
        usable = [s is not None for s in symbols]
        for made in sorted((i for i in range(size) if self.made[i] >= 0), key=self.made.__getitem__):
            usable[made] = usable[self.left[made]] and usable[self.right[made]] and self._whole(made)
        self._automaton([(s, number) for number, s in enumerate(symbols) if s is not None and usable[number]])

    def _whole(self, token: int) -> bool:
        """Whether a token's halves come to stand side by side: no earlier merge crosses the border between them."""
        left, right, until = self.left[token], self.right[token], self.made[token]
        while self.made[left] >= 0 or self.made[right] >= 0:
            if self.made[left] > self.made[right]:
                until, left = self.made[left], self.right[left]
            else:
                until, right = self.made[right] + 1, self.left[right]
            if self.rank.get(left << 20 | right, 1 << 30) < until:
                return False
        return True

    def _automaton(self, tokens: list[tuple[tuple[int, ...], int]]) -> None:
        """goto by state and symbol, the state of the longest proper suffix, and the longest token that ends in a state."""
        self.goto: dict[int, int] = {}
        self.fail, self.ends, self.shorter, self.length = array("i", [0]), array("i", [-1]), array("i", [-1] * len(self.pieces)), array("i", [0] * len(self.pieces))
        for symbols, number in tokens:
            state = 0
            for s in symbols:
                key = state << 16 | s
                state = self.goto.get(key) or self.goto.setdefault(key, len(self.fail))
                if state == len(self.fail):
                    self.fail.append(0)
                    self.ends.append(-1)
            self.ends[state], self.length[number] = number, len(symbols)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.goto.items():
            below.setdefault(key >> 16, []).append((key & 0xFFFF, state))
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for s, child in below.get(state, ()):
                self.fail[child] = self._step(self.fail[state], s) if state else 0
                inherited = self.ends[self.fail[child]]
                if self.ends[child] < 0:
                    self.ends[child] = inherited
                else:
                    self.shorter[self.ends[child]] = inherited
                queue.append(child)

    def _step(self, state: int, symbol: int) -> int:
        while True:
            found = self.goto.get(state << 16 | symbol)
            if found is not None:
                return found
            if not state:
                return 0
            state = self.fail[state]


class WordTrie:
    """The states of every prefix of the words put in, and the words' ids."""

    def __init__(self, merges: Merges):
        if sorted(merges.inner) != list(range(256)):
            raise ValueError("the 256 bytes must have the ids up to 255")
        self.merges, self.symbols = merges, bytes.maketrans(bytes(range(256)), bytes(merges.inner))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.state, self.last, self.back = array("i", [0]), array("i", [-1]), array("i", [0])

    def put(self, word: bytes, shared: bool = True) -> bytes:
        """The word's ids as little-endian 32-bit numbers; makes the nodes that it doesn't share with the words before it."""
        m, children = self.merges, self.children
        states, last, back = self.state, self.last, self.back
        path = [0]  # the nodes from the root on
        if shared:
            node = 0
            for symbol in word[:-1].translate(self.symbols):
                node = children.get(node << 10 | symbol)
                if node is None:
                    break
                path.append(node)
        depth = len(path) - 1
        symbols = [*word[depth:-1].translate(self.symbols), m.last[word[-1]]]
        if shared and len(symbols) == 1:
            node = children.get(path[-1] << 10 | symbols[0])
            if node is not None:
                path.append(node)
                symbols = []
        goto, fail, ends, length, shorter, pairs, agrees = m.goto, m.fail, m.ends, m.length, m.shorter, m.pairs, m.agrees
        node = path[-1]
        state, made = states[node], len(last)
        for symbol in symbols:
            depth += 1
            found = goto.get(state << 16 | symbol)
            while found is None:
                if not state:
                    found = 0
                    break
                state = fail[state]
                found = goto.get(state << 16 | symbol)
            state, token = found, ends[found]
            while True:
                start = path[depth - length[token]]
                if not start:
                    break
                known = pairs.get(last[start] << 20 | token)
                if known or known is None and agrees(last[start], token):
                    break
                token = shorter[token]
            states.append(state)
            last.append(token)
            back.append(start)
            if shared:
                children[node << 10 | symbol] = made
            path.append(made)
            node, made = made, made + 1
        ids = array("I")
        while node:
            ids.append(last[node])
            node = back[node]
        ids.reverse()
        return ids.tobytes()

    def alone(self, word: bytes) -> bytes:
        """The ids of a long word, whose nodes aren't kept."""
        had = len(self.last)
        ids = self.put(word, shared=False)
        for column in (self.state, self.last, self.back):
            del column[had:]
        return ids


class WordBpe:
    """Encodes and decodes texts. The ids of runs without white space are kept, so are those of words seen before."""

    def __init__(self, merges: Merges):
        self.trie, self.pieces = WordTrie(merges), merges.pieces
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.special_ids = {content: number.to_bytes(4, "little") for content, number in merges.special.items()}
        self.split = regex.compile(merges.pattern).findall
        self.assigned: set[str] = set()
        self.library = Tokenizer.from_str(merges.file)

    def _known(self, text: str) -> bool:
        """Whether this Python's tables assign all code points of a text."""
        new = set(text).difference(self.assigned)
        if any(unicodedata.category(ch) == "Cn" for ch in new):
            return False
        self.assigned |= new
        return True

    def _of_words(self, words: list[str]) -> None:
        """Sees to it that the ids of all these are at hand. Sorted words make the trie depth first."""
        new = sorted(set(words).difference(self.words))
        if len(self.words) + len(new) > WORDS or len(self.trie.last) > NODES:
            self.words.clear()
            self.trie.clear()
            new = sorted(set(words))
        for word in new:
            raw = word.encode()
            self.words[word] = self.trie.put(raw) if len(raw) <= LONG else self.trie.alone(raw)

    def _of_plain(self, text: str) -> bytes:
        if not text.isascii() and not self._known(text):
            letters = {ch: b for b, ch in enumerate(byte_alphabet())}
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            parts = [bytes(letters[ch] for ch in part).decode() for part, _ in found]
            self._of_words(parts)
            return b"".join(map(self.words.__getitem__, parts))
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself, whatever follows it
        runs = [text] if ODD(text) else text.split()  # no match of the pattern has white space within
        new = [*set(runs).difference(self.runs)]
        if new:
            if len(self.runs) + len(new) > WORDS:
                self.runs.clear()
                new = [*set(runs)]
            parts = list(map(self.split, new))
            self._of_words(list(chain.from_iterable(parts)))
            for run, words in zip(new, parts, strict=True):
                self.runs[run] = b"".join(map(self.words.__getitem__, words))
        return b"".join(map(self.runs.__getitem__, runs))

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self.special.split(text or "") if self.special else [text or ""]
        return np.frombuffer(b"".join(self.special_ids.get(p) or self._of_plain(p) for p in pieces), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))


def coder(df: DataFrame, path: str) -> Callable[[], WordBpe]:
    """Makes the coder of a task. What is sent to every executor is as large as the vocabulary file."""
    sent = df.sparkSession.sparkContext.broadcast(Merges(path))
    return lambda: WordBpe(sent.value)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every whole text."""
    rows, make = texts_of(df, id_col, text_col), coder(df, path)

    def start():
        bpe = make()
        return lambda batch: pa.RecordBatch.from_arrays([batch["id"], pa.array([bpe.encode(t.as_py()) for t in batch["text"]], pa.list_(pa.int32()))], ["id", "ids"])

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the written form of every list of ids; a null list is the empty text."""
    rows, make = df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids"), coder(df, path)

    def start():
        bpe = make()
        return lambda batch: pa.RecordBatch.from_arrays([batch["id"], pa.array([bpe.decode(ids or ()) for ids in batch["ids"].to_pylist()], pa.string())], ["id", "decoded"])

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that neither is moved."""
    rows, make = texts_of(df, id_col, text_col), coder(df, path)

    def start():
        bpe = make()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_of, text_of = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                ids_of.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_of.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(text_of, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
