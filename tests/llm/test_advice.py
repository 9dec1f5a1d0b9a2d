"""Cases in which an operator once did less than the whole job."""

import random
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestone.llm import blocks, class_lm, decontaminate, langid, secrets, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "ing", "on", "ea", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def put(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


def test_unrelated_texts_without_or_with_the_same_id_stay(spark):
    rng = random.Random(11)
    free, same = [words(rng, 60) for _ in range(4)], [words(rng, 60) for _ in range(3)]
    rows = [(None, t, "en") for t in [*free, free[0]]] + [(7, t, "en") for t in same] + [(8, same[0], "en"), (None, same[1], "en")]
    kept = simhash.keep_one(put(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, t) for t in free] + [(7, t) for t in same])


def test_secrets_without_a_digit_and_beyond_a_base_value():
    guesses = lambda text: [text[a:b] for _, kind, _, a, b, _ in secrets.find(text) if kind == "guess"]
    for value in ("Vx#qLpZ!rTnB&wKs", "hunter2hunter2x9!Kd#82hxQ", "0123456789abcdef!Kd#82hxQ", "zürich-Öl#9Kd!xQw"):
        text = f'a password: "{value}" here'
        assert guesses(text) == [value] and secrets.redacted(text) == 'a password: "[SECRET]" here'
    for text in ("passphrase: documentation.", "Credentials: Donaudampfschifffahrt", "BEARER: CONFIDENTIALITY", "secret: 日本語のパスワード、設定について"):
        assert guesses(text) == [] and secrets.redacted(text) == text
    assert secrets.redacted("passcode: xqLpZvrTnBwKsGhJ, pwd=8305518264097713") == "passcode: [SECRET], pwd=[SECRET]"
    assert guesses('password = "hunter2hunter2x9"') == []


def test_every_letter_of_the_learning_texts_counts():
    rng = random.Random(4)
    letters = lambda first, n: "".join(chr(first + rng.randrange(400)) + " " * (rng.random() < 0.1) for _ in range(n))
    samples = {"a": letters(0x4E00, 1500), "b": letters(0x4E00, 1500) + letters(0xAC00, 500), "c": "plain words of some other language " * 9}
    predictor = langid.Predictor(langid.CrossParser(samples))
    own = samples["b"][300:700]
    for text in (own, samples["a"][100:180], letters(0x4E00, 50) + "\u0416 words" + letters(0xAC00, 50), letters(0x4F00, 60)):
        text = langid.normal(text)
        found = predictor.phrases([predictor.codes(text)])[0].tolist()
        for lang, count in zip(predictor.parser.languages, found, strict=True):
            rest, learned, phrases = text, langid.normal(samples[lang]), 0
            while rest:
                n = next((n for n in range(len(rest), 0, -1) if rest[:n] in learned), 1)
                rest, phrases = rest[n:], phrases + 1
            assert count == phrases
    assert predictor.predict([own])[0] == ["b"]


def test_rare_words_have_the_class_of_their_neighbours():
    """Rare words of one ending, and so of one unit, are told apart by what stands beside them; unseen words are not."""
    texts = ["left xsame", "left u", "ysame right", "v right"] * 9
    row = next(blocks.rows_of(blocks._close(0, [*[(i, True, t.encode().split()) for i, t in enumerate(texts)], (99, False, [b"zsame"])])))
    frequent = {b"left": 1, b"right": 2, b"u": 3, b"v": 4}
    of = np.full(1 + class_lm.FREQUENT + class_lm.ENDINGS, 3)
    of[:5] = range(5)
    moves = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    moves[[0, 1, 3, 0, 3, 4, 2, 0], [1, 3, 0, 3, 2, 2, 0, 4]] = [18, 18, 18, 9, 9, 9, 18, 9]
    (bucket, block, asked), *_ = class_lm._neighbours(row, frequent, of, 1)
    told = class_lm._assign(pa.table({"bucket": pa.array([bucket], pa.int32()), "block": [block], "asked": [asked]}), frequent, of, moves)
    found = dict(zip(asked["words"].split(b"\n"), blocks.widen(told["answer"][0].as_py()).tolist(), strict=True))
    classes, counts = {w: n & 255 for w, n in found.items()}, {w: n >> 8 for w, n in found.items()}
    assert counts == {b"left": 18, b"right": 18, b"u": 9, b"v": 9, b"xsame": 9, b"ysame": 9, b"zsame": 0}
    assert classes[b"xsame"] != classes[b"ysame"] == 4 and classes[b"zsame"] == 3


def test_a_corpus_without_labels_stays(spark, sf_dir):
    docs = put(spark, [(1, "some text", None), (2, "12 !", None), (None, "日本", None), (4, None, None), (5, "", None)])
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, sf_dir))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1]


def test_leaking_rows_go_whatever_their_ids(spark):
    rng = random.Random(3)
    item, clean = words(rng, 20), [words(rng, 30) for _ in range(3)]
    rows = [(None, f"{clean[0]} {item}", "en"), (None, clean[0], "en"), (3, item, "en"), (3, clean[1], "en"), (4, clean[2], "en")]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.without_leaks(put(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, clean[0]), (3, clean[1]), (4, clean[2])]


def test_context_moves_the_score_of_what_is_confirmed(spark):
    from lodestone.llm import pii

    texts = {1: "ip address 10.0.0.1 here", 2: "in version 10.0.0.1 here", 3: "see 10.0.0.1 here", 4: "pay 4111 1111 1111 1111 by card", 5: "4111 1111 1111 1111", 6: "4111 1111 1111 1112 card",
             7: "account GB82 WEST 1234 5698 7654 32", 8: "GB82 WEST 1234 5698 7654 32", 9: "GB82 WEST 1234 5698 7654 33 iban", 10: "123-45-6789 (SSN)", 11: "123-45-6789"}
    found = {r["id"]: [(s["kind"], round(s["score"], 1)) for s in r["spans"]] for r in pii.pii_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert found == {1: [("ip", 0.9)], 2: [("ip", 0.3)], 3: [("ip", 0.6)], 4: [("card", 1.0)], 5: [("card", 0.7)], 6: [], 7: [("iban", 1.0)], 8: [("iban", 0.9)], 9: [], 10: [("ssn", 0.7)], 11: []}


def test_parsing_does_not_depend_on_segments(monkeypatch):
    """Phrases of whole texts, however they are cut, are those of a plain walk from the beginning."""
    rng = random.Random(8)
    samples = {"a": words(rng, 900), "b": words(random.Random(9), 900), "c": "une autre langue avec d'autres mots " * 20}
    predictor = langid.Predictor(langid.CrossParser(samples))
    parser = predictor.parser
    texts = [samples["a"][500:3500], words(rng, 700), samples["a"] + samples["b"], "ab" * 900, "the " * 900, "\u65e5\u672c" * 700, "x", samples["b"][:40] * 30]
    rows = [predictor.codes(t) for t in texts]
    plain = []
    for codes in rows:
        counts = []
        for lang in parser.languages:
            edges, at, n = langid.suffix_automaton([parser.code[ch] for ch in langid.normal(samples[lang])]), 0, 0
            for c in codes.tolist():
                n, at = (n, edges[at][c]) if at and c in edges[at] else (n + 1, edges[0].get(c, 0))
            counts.append(n)
        plain.append(counts)
    for size in (1, 3, 17, 256, 1024):
        monkeypatch.setattr(langid, "SEGMENT", size)
        assert predictor.phrases(rows).tolist() == plain
    bits = np.array(plain) * parser.bits
    assert predictor.predict(texts)[0] == [parser.languages[i] for i in bits.argmin(1)]
    weights = np.exp2((bits.min(1, keepdims=True) - bits) / 8)
    assert np.allclose(predictor.predict(texts)[1], (weights.max(1) / weights.sum(1)))


def test_the_learning_sample_is_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGE_CHARS", 100)
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"kurzer text {i}", "de") for i in free[:60]] + [(i, f"much longer text {i} " * 20, "en") for i in free[60:90]]
    rows += [(free[0], "el mismo texto", "es")] * 50 + [(i, "held out", "xx") for i in range(400) if i not in free] + [(None, None, "fr"), (free[1], "12 3", "it"), (None, "texte sans nom", "fr")]
    found = langid.learning_sample(put(spark, rows))
    assert set(found) == {"de", "en", "es", "fr"} and found["es"] == "el mismo texto" and found["fr"] == "texte sans nom"
    texts = {t for _, t, _ in rows}
    assert found["en"] in texts and len(found["de"]) > 60 and set(found["de"].split("\n")) <= texts


def test_missing_labels_are_filled(spark):
    rows = [(i, f"the words of this {i}", "en") for i in range(30)] + [(50 + i, f"die wörter von dem {i}", "de") for i in range(30)] + [(100, "wörter von die", None), (101, "these words of the", None), (102, "the words", "xx"), (103, "12", None), (104, None, "en")]
    docs = put(spark, rows)
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_identified(docs, langid.learn(docs)).collect()}
    assert kept == {i: lang for i, _, lang in rows[:60]} | {100: "de", 101: "en", 102: "xx"}


def test_the_learning_sample_is_bounded(spark, monkeypatch):
    """Neither many labels nor long documents make it larger than its bounds."""
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    monkeypatch.setattr(langid, "LANGUAGE_CHARS", 200)
    monkeypatch.setattr(langid, "ALL_CHARS", 1000)
    rows = [(i, f"word{i} " * 400 if i % 2 else f"some {i}", f"junk{i}") for i in range(200)] + [(1000 + i, "the cat " * 500, "en") for i in range(30)] + [(2000 + i, f"le chat {i}", "fr") for i in range(20)]
    sample = langid.learning_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(sample) == 5 and {"en", "fr"} <= set(sample) and max(map(len, sample.values())) <= 1000
    assert sample["en"] == ("the cat " * 125) and "le chat" in sample["fr"]
