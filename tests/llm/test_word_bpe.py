"""Operator 12 against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestone.llm import queries as Q
from lodestone.llm import word_bpe

PATH = P.path(Q.WORDS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return word_bpe.Merges(PATH)


def same(bpe, library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    found = bpe.encode(text).tolist()
    return found == ids and bpe.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(merges, library):
    bpe = word_bpe.WordBpe(merges)
    for text in ["", None, " \t\n", "It's we'LL they'Ve 12,345.6", "ΑΣ ΟΔΟΣ İx ß", "é ＡＢ ﬁ ẞ", "a\x1cb\x85c\xa0d e", "x\x00y﻿", "日本語 😀👩‍👩‍👧 ͸ \U000e0001", "<|startoftext|>Hello <|endoftext|><|endoftext|> <|END", "a" * 300_000, "!?" * 5000]:
        assert same(bpe, library, text), repr(text)[:80]


def test_random_texts(merges, library, monkeypatch):
    """Also where caches and trie start anew again and again."""
    monkeypatch.setattr(word_bpe, "NODES", 300)
    monkeypatch.setattr(word_bpe, "WORDS", 40)
    bpe, rng = word_bpe.WordBpe(merges), random.Random(2)
    for k in range(3000):
        letters = "abehilnorstABé '.!1ßΣ日́\n" if k % 2 else "aehilnorst "
        assert same(bpe, library, "".join(rng.choice(letters) for _ in range(rng.randrange(90))))


def test_order_of_words_does_not_matter(merges):
    words = sorted({p.removesuffix("</w>").encode("ascii", "ignore") for p in merges.pieces[600:3000]} - {b""})
    first, second = word_bpe.WordTrie(merges), word_bpe.WordTrie(merges)
    ids = {w: first.put(w) for w in words}
    assert {w: second.put(w) for w in reversed(words)} == ids and {w: second.alone(w) for w in words} == ids
    assert len(first.last) == len(second.last) == len({w[:i] for w in words for i in range(len(w))} | {w + b"$" for w in words})


def test_tokens_that_no_text_has(tmp_path):
    """A merge whose halves an earlier merge tears apart is never reached."""
    letters = word_bpe.byte_alphabet()
    pieces = [*letters, *(x + "</w>" for x in letters)]
    merges = [("b", "c"), ("a", "b"), ("c", "d</w>"), ("ab", "cd</w>"), ("a", "bc")]
    pieces += ["".join(m) for m in merges]
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"] |= {"vocab": {p: i for i, p in enumerate(pieces)}, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    bpe, library = word_bpe.WordBpe(word_bpe.Merges(str(path))), Tokenizer.from_file(str(path))
    assert len(pieces) - 2 not in bpe.trie.merges.length or not bpe.trie.merges.length[pieces.index("abcd</w>")]
    for text in ("abcd", "abc", "ab", "bcd", "aabbccdd abcd abcda", "cd"):
        assert same(bpe, library, text)


def test_query(spark, sf_dir, rows, library):
    found = {r["doc_id"]: r for r in Q.op12_word_bpe(spark, sf_dir).collect()}
    assert len(found) == len(rows[0])
    for i, text, *_ in rows[0]:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), *digests)


def test_encode_then_decode(spark, library):
    df = spark.createDataFrame([("a", "Hello there"), ("b", None), (None, "Ünder <|endoftext|>")], "id string, text string")
    ids = word_bpe.encode(df, PATH, "id")
    assert {r["id"]: r["ids"] for r in ids.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in (("a", "Hello there"), ("b", ""), (None, "Ünder <|endoftext|>"))}
    texts = {r["id"]: r["decoded"] for r in word_bpe.decode(ids, PATH).collect()}
    assert texts == {"a": "hello</w> there</w>", "b": "", None: library.decode(library.encode("Ünder <|endoftext|>", add_special_tokens=False).ids, skip_special_tokens=False)}
