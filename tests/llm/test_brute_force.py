"""Every operator against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import blocks, byte_bpe, class_lm, decontaminate, langid, quality, secrets, simhash, substring_dedup, token_counts
from lodestone.llm import queries as Q


def by_id(spark, sf_dir, name):
    return {r["doc_id"]: r for r in Q.queries()[name](spark, sf_dir).collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_class_lm(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op1_class_lm")
    tokens = {i: [*t.encode().lower().split(), None] for i, t, *_ in rows[0]}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    better = [got[i]["score"] - got[i]["base_score"] for i in tokens if held[i]]
    assert sum(better) > 0


def test_class_lm_sums_to_one():
    rng = np.random.default_rng(3)
    of = class_lm.exchange(rng.integers(0, 5, (40, 40)), 6)
    assert of[0] == 0 and set(of[1:]) <= set(range(1, 6))
    tokens, once = np.array([5.0, 9.0]), np.array([0.0, 3.0])
    model = class_lm.Model({}, of, np.zeros((2, 2)), tokens, once, 14, 5, 5)
    counts = np.array([1, 1, 1, 2, 4, 0])  # all words of class 1, and the unseen ones together
    assert (10 ** model.emission(counts, np.ones(6, int))).sum() == pytest.approx(1)


def test_exchange_gains_what_it_counts():
    rng = np.random.default_rng(1)
    blocks_ = np.kron(np.array([[0, 9], [9, 0]]), np.ones((6, 6), int)) + rng.integers(0, 2, (12, 12))
    bigrams = np.zeros((13, 13))
    bigrams[1:, 1:] = blocks_
    of = class_lm.exchange(bigrams, 3)
    assert len(set(of[1:7])) == len(set(of[7:])) == 1 and of[1] != of[7]


def test_language_id(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op2_language_id")
    mixed = {*range(10, 26), 31}  # texts that others repeat under another label
    long = [(i, lang) for i, t, lang, *_ in rows[0] if i < 100 and i not in mixed]
    assert all(got[i]["lang_pred"] == lang for i, lang in long)
    assert got[152]["lang_pred"] == "und" and got[152]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_cross_parsing_counts_longest_matches():
    samples = {"a": "banana bandana", "b": "cabbage garbage"}
    predictor = langid.Predictor(langid.CrossParser(samples))
    for text in ("bananas and cabbages", "x", "garbage banana", "zzz", "abba"):
        codes = predictor.codes(text)
        for column, lang in enumerate(predictor.parser.languages):
            rest, learned, phrases = langid.normal(text), langid.normal(samples[lang]), 0
            while rest:
                n = 1
                while n < len(rest) and rest[: n + 1] in learned:
                    n += 1
                rest, phrases = rest[n:], phrases + 1
            assert predictor.phrases([codes])[0, column] == phrases


def test_byte_bpe(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op3_byte_bpe")
    ranks = byte_bpe.read_ranks(P.path(Q.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t, *_ in rows[0]:
        ids = encoding.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def test_byte_bpe_tables(spark):
    df = spark.createDataFrame([(1, "héllo  wörld\n\n 😀<|endoftext|>"), (2, None)], "doc_id bigint, text string")
    ids = byte_bpe.encode(df, P.path(Q.RANKS), P.PATTERN)
    back = {r["id"]: bytes(r["decoded"]) for r in byte_bpe.decode(ids, P.path(Q.RANKS), P.PATTERN).collect()}
    assert back == {1: "héllo  wörld\n\n 😀<|endoftext|>".encode(), 2: b""}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def check_pii(got, texts):
    for i, t in texts:
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if passes(kind, m.group()))
        assert got[i]["base_sha256"] == sha(",".join(s for _, _, s in spans)), (t, spans, got[i])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for _, _, s in spans) for k in BASE]


def test_pii(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op4_pii")
    check_pii(got, [(r[0], r[1]) for r in rows[0]])
    assert re.findall(r"(?:iban|ssn):\d+:\d+", got[131]["spans"]) == ["ssn:10:21", "iban:47:74"]


def test_pii_tricky(spark, tmp_path):
    texts = ["a@b.c_d@e.f%g@h.i", "@@a@b@c.d.e..f@g.h", "1.2.3.4.5.6.7.8.9", "001.02.3.4 999.1.1.1.1", "4111-1111 1111  1111", "4111 1111 1111 1111 4111 1111 1111 1111", "+1 234 567 89-01+12345678901234567", "é😀 a@b.co +49 (30) 1234-5678.", "+1" + " " * 50, "1" * 300, "a" * 3000 + "@x", "7 " * 200 + "1.1.1.1 " * 100]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_pii(by_id(spark, str(tmp_path), "op4_pii"), rows)


def test_quality(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op5_quality_rules")
    for i, t, *_ in rows[0]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r["kept"] == (not r["base_failed"] and not any(rule(quality.Text(t)) for rule in quality.RULES.values()))
    assert all(got[i]["kept"] for i in range(60)) and not got[150]["kept"] and not got[151]["kept"]


def test_cascade_order_is_rejections_per_cost():
    measured = {"few_words": (10.0, 0.1), "symbols": (100.0, 0.9), "word_length": (1000.0, 0.0)}
    order = quality.plan(measured)
    assert order[:3] == ["few_words", "symbols", "word_length"]
    assert set(order) == set(quality.RULES)


def test_token_counts(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op6_token_counts")
    tokenizer = Tokenizer.from_file(P.path(Q.TOKENIZER))
    for i, t, *_ in rows[0]:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_every_prefix():
    spec = token_counts.read_merges(P.path(Q.TOKENIZER))
    counter, tokenizer = token_counts.PrefixCounts(spec["merges"], spec["special"], P.PATTERN), Tokenizer.from_file(P.path(Q.TOKENIZER))
    for text in ("don't we'll  they're 'tis", "a   b\n\nc  \n d", "x <|endoftext|> y <|endof <|endoftext|>z", "été 日本語 😀😀", "'''s 'v've\n\n's", "\t\tfoo bar  ", "aaaaaaaaaabbbbbbbbbb"):
        steps = counter.differences(text)
        exact = [len(tokenizer.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert [token_counts.at_prefix(steps, n) for n in range(len(text) + 1)] == exact
        assert all(exact[token_counts.longest_prefix(steps, b)] <= b for b in range(exact[-1] + 1))


@pytest.mark.parametrize("size", [1_000_000, 300])
def test_substring_dedup(spark, sf_dir, rows, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", size)
    got = by_id(spark, sf_dir, "op7_substring_dedup")
    seen = set()
    for i, t, *_ in sorted(rows[0]):
        words, gone = t.split(), set()
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone |= set(range(j, j + 20))
            seen.add(key)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), len(gone), sha(kept)), i


def test_difference_cover():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert substring_dedup.ANCHOR + period - 1 <= substring_dedup.WINDOW
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op8_simhash")
    prints = {i: fingerprint(t) for i, t, *_ in rows[0]}
    left, component = set(prints), {}
    while left:
        first = min(left)
        reach, todo = {first}, [first]
        while todo:
            at = todo.pop()
            new = {i for i in left if (prints[i] ^ prints[at]).bit_count() <= 3} - reach
            reach |= new
            todo += new
        component |= dict.fromkeys(reach, first)
        left -= reach
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", component[i]) for i in prints}


@pytest.mark.parametrize("width", [1, 2, 4])
def test_tiles_lose_no_link(spark, monkeypatch, width):
    monkeypatch.setattr(simhash, "WIDTHS", ((1 << 62, width),))
    monkeypatch.setattr(simhash, "LEAST_TILE", 16)
    monkeypatch.setattr(simhash, "TILES", 10_000)
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    rng = np.random.default_rng(width)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (240, 3), dtype=np.uint64)).sum(1, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds, seeds[rng.integers(0, 60, 240)] ^ flips, np.zeros(1, np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print bigint")
    label = {int(p): int(p) for p in prints.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in simhash.links(df).collect():
        assert (r["a"] % (1 << 64) ^ r["b"] % (1 << 64)).bit_count() >= 0
        label[root(r["a"])] = root(r["b"])
    for i, p in enumerate(prints):
        for q in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ p) <= 3]:
            assert root(int(p.view(np.int64))) == root(int(q.view(np.int64)))


def test_secrets(spark, sf_dir, rows):
    got = by_id(spark, sf_dir, "op9_secret_scan")
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for i, t, *_ in rows[0]:
        spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        names = ("assign", "access", "hex")
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == sha(base)
        assert set(base.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "guess:" in got[140]["spans"] and all("guess" not in r["spans"] for i, r in got.items() if i < 130)


def test_guess_cost():
    bits = secrets.USUAL.bits
    assert bits("password") < bits("pa55word1") < bits("xkqzvbnw") < bits("Xk9$vB!wQz")
    assert bits("qwertyuiop") < 15 and bits("aaaaaaaaaa") < 12 and bits("abcdefghij") < 14 and bits("20240131") < 17
    assert bits("x" * 10_000) < 30 and bits("Zq8$" * 5000) > 10_000
    assert secrets.redacted('token = "24be64439e3e49cf46b2" 4785380592391139') == 'token = "[SECRET]" 4785380592391139'


def test_decontamination(spark, sf_dir, rows):
    found = Q.queries()["op10_decontamination"](spark, sf_dir).collect()
    item = rows[1].lower().split()
    shingles = lambda ws: [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)] or ([tuple(ws)] if ws else [])
    wanted = Counter(shingles(item))
    m, expected = sum(wanted.values()), {}
    for i, t, *_ in rows[0]:
        own = shingles(t.lower().split())
        for start in range(max(0, len(own) - m) + 1):
            window = Counter(own[start : start + m])
            common = sum((window & wanted).values())
            s = common / (m + sum(window.values()) - common)
            if s >= 0.8:
                expected[i] = max(s, expected.get(i, 0))
    assert {120, 121, 122} <= set(expected)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == pytest.approx({(i, 7): s for i, s in expected.items()})


def test_blocks_hold_every_item_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        b = a ^ sum(1 << int(x) for x in flips)
        pairs.append((a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    near = decontaminate._blocks(F.col("b"), [0, 1, 2, 4, 8])
    assert df.where(~F.arrays_overlap(decontaminate._blocks(F.col("a"), [0]), near)).count() == 0


def test_pairs_of_prints_are_told_once(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, 20)) for _ in range(60)]
    items = decontaminate.items_of(spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")).dropDuplicates(["told"]).cache()
    windows = items.select("m", F.col("told").alias("key"), decontaminate._simhash("item").alias("print")).cache()
    found = [(r["key"], r["told"]) for r in decontaminate._proposed(windows, items).collect()]
    prints = {r["key"]: r["print"] % (1 << 64) for r in windows.collect()}
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= decontaminate.RADIUS}


def test_links_join_over_chains(spark):
    from lodestone.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 130)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    groups = defaultdict(set)
    for node, root in got.items():
        groups[root].add(node)
    assert groups == {0: set(range(1, 41)), 100: set(range(101, 130))}
