"""Every query and stage on odd rows, with the values that they have there, and on no rows."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from test_brute_force import BASE, fingerprint, sha
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import byte_bpe
from lodestone.llm import queries as Q

NAMES = sorted(Q.queries())
NO = 1 << 62


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd_dir, name):
    found = Q.queries()[name](spark, odd_dir).collect()
    if name.startswith("op10"):
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, 1), (4, 1), (7, 1)}
    elif name.startswith("op13"):
        assert sorted((r["vec_id"] or 0, r["distance"]) for r in found) == [(0, 0), (0, 0), (1, 0), (1, 0), (8, 0), (9, 0)]
    else:
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
        assert ids == sorted([(True, 0)] * 2 + [(False, i) for i in (1, 2, 3, 4, 4, 5, 6, 7, 8, 9)])


@pytest.fixture(scope="module")
def odd(spark, odd_dir):
    """(id, text) of every row, and a query's rows in the same order, matched by id and a value that tells texts apart."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").collect()]

    def match(name, tells):
        """Pairs of (text, result) in which ``tells`` of the text is ``tells`` of the result; each result is used once."""
        left = list(Q.queries()[name](spark, odd_dir).collect())
        pairs = []
        for i, t in rows:
            at = next(k for k, r in enumerate(left) if r["doc_id"] == i and tells[1](r) == tells[0](t or ""))
            pairs.append((i, t or "", left.pop(at)))
        assert not left
        return pairs

    return match


def n_words(text):
    return len(text.encode().split())


def test_values_of_tokens(odd):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(Q.RANKS)), special_tokens={})
    ids = lambda t: encoding.encode_ordinary(t)
    for _, t, r in odd("op3_byte_bpe", (lambda t: len(ids(t)), lambda r: r["n_tokens"])):
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha(" ".join(map(str, ids(t)))), sha(t))
    count = lambda t: len(Tokenizer.from_file(P.path(Q.TOKENIZER)).encode(t, add_special_tokens=False).ids)
    for _, t, r in odd("op6_token_counts", (count, lambda r: r["n_tokens"])):
        assert (r["n_bytes"], r["over_limit"]) == (len(t.encode()), r["n_tokens"] > 1024)


def test_values_of_models(odd):
    found = odd("op1_class_lm", (lambda t: n_words(t) + 1, lambda r: r["n_tokens"]))
    train = [t for i, t, _ in found if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    known = {w for t in train for w in t.lower().encode().split()}
    for i, t, r in found:
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2) and r["train_tokens"] == sum(n_words(t) + 1 for t in train)
        assert r["n_known"] == 1 + sum(w in known for w in t.lower().encode().split()) and r["score"] < 0 > r["base_score"]
    assert len({(r["score"], r["base_score"]) for _, t, r in found if not t.strip()}) == 1
    for i, t, r in odd("op2_language_id", (lambda t: any(map(str.isalpha, t)), lambda r: r["lang_pred"] != "und")):
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and (r["score"] > 0) == any(map(str.isalpha, t))


def test_values_of_spans_and_rules(odd):
    nothing = hashlib.sha256(b"").hexdigest()
    for name, kinds in (("op4_pii", BASE), ("op9_secret_scan", ("assign", "access", "hex"))):
        for _, _, r in odd(name, (lambda t: 0, lambda r: 0)):
            assert r["base_sha256"] == nothing and r["spans"] == "" and all(r[f"n_{k}"] == 0 for k in kinds)
    for i, t, r in odd("op5_quality_rules", (n_words, lambda r: r["n_words"])):
        assert r["word_chars"] == sum(len(w.decode()) for w in t.encode().split()) and r["n_dup_lines"] == r["n_symbols"] == 0
        assert r["n_repeat_words"] == (n_words(t) if i in (7, 8, 9) else 0) and r["base_failed"] == (n_words(t) < 20 or i in (7, 8, 9)) and r["kept"] <= (not r["base_failed"])


def test_values_of_copies(odd):
    """Rows that repeat an id are one document, null ids are behind all others, and a document may repeat itself."""
    for i, t, r in odd("op7_substring_dedup", (n_words, lambda r: r["n_words"])):
        first = {8: 1, 9: n_words(t) // 50}.get(i, 0)  # words before a text repeats itself
        removed = n_words(t) - first if i in (None, 7, 8, 9) else 0
        words = t.encode().split()
        assert (r["n_removed"], r["kept_sha256"]) == (removed, sha(b" ".join(words[:first] if removed else words)))
    found = odd("op8_simhash", (lambda t: f"{fingerprint(t):016x}", lambda r: r["fingerprint"]))
    prints = [(NO if i is None else i, fingerprint(t)) for i, t, _ in found]
    for at, (_, _, r) in enumerate(found):
        reach, todo = {at}, [at]
        while todo:
            a = todo.pop()
            new = {b for b in range(len(prints)) if (prints[a][1] ^ prints[b][1]).bit_count() <= 3} - reach
            reach |= new
            todo += new
        assert r["component_id"] == min(prints[b][0] for b in reach)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, empty_dir, name):
    df = Q.queries()[name](spark, empty_dir)
    assert df.collect() == []
    assert ("vec_id" if name.startswith("op13") else "doc_id") in df.columns


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline(spark, odd_dir, empty_dir, which):
    path = odd_dir if which == "odd" else empty_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        docs = corpus_pipeline.stored(stage(spark, docs, path))
        assert last or docs.columns == columns
        docs.count()
