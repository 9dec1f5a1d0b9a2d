import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import context, metrics, services
from lodestone.operators.retrieve import captions_of_matches
from lodestone.plans import experiments
from lodestone.sources import captions, embeddings, sinks


def test_measures(spark):
    preds = spark.createDataFrame([(0, 1, 5), (0, 2, 7), (0, 3, 8), (1, 1, 1)], "q_id bigint, rank int, id bigint")
    gold = spark.createDataFrame([(0, 7), (0, 8), (0, 9), (1, 2), (2, 3)], "q_id bigint, id bigint")
    r = metrics.summary(preds, gold, (1, 3)).first()
    assert r["n_queries"] == 3 and r["recall_1"] == 0 and r["recall_3"] == pytest.approx(1 / 3)
    assert r["precision_3"] == pytest.approx(2 / 9) and r["mrr"] == pytest.approx(0.5 / 3)
    assert r["map_retrieved"] == pytest.approx((1 / 2 + 2 / 3) / 2 / 3) and r["map_all"] == pytest.approx((1 / 2 + 2 / 3) / 3 / 3)


def test_latency(spark):
    r = metrics.latency(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "ms double"), "ms").first()
    assert (r["p50_ms"], r["p95_ms"], r["p99_ms"]) == pytest.approx((2.5, 8.95, 9.79))
    assert r["std_ms"] == pytest.approx(np.std([1, 2, 3, 10]))


def test_context_and_prompts(spark):
    found = spark.createDataFrame([(0, 1, 42, 0.95), (0, 2, 17, 0.87), (0, 3, 99, 0.76), (1, 1, 5, 0.5)], "q_id bigint, rank int, id bigint, score double")
    texts = spark.createDataFrame([(42, "a dog"), (17, "100% {query} cat"), (99, "left out")], "id bigint, caption string")
    got = {r["q_id"]: r["context"] for r in context.context(found, texts, max_items=2).collect()}
    assert got[0] == "[1] (Score: 0.950) Caption: a dog\n[2] (Score: 0.870) Caption: 100% {query} cat" and got[1] == "[1] (Score: 0.500)"
    assert {r["context"] for r in context.context(found, texts, include_captions=False).collect()} == {context.EMPTY}
    row = spark.createDataFrame([("50% off {x}", "ctx")], "q string, c string")
    said = row.select(context.retrieval_prompt(F.col("q"), F.col("c")).alias("p"), context.comparison_prompt(F.col("q"), F.col("c"), F.col("c"), "one", "two").alias("v")).first()
    assert "50% off {x}" in said["p"] and "ctx" in said["p"] and "Results of two:" in said["v"]


def test_judgements(spark):
    replies = ['{"relevance": 5, "accuracy": 4, "usefulness": 3}', 'x ```json\n{"relevance": 1, "accuracy": 2, "usefulness": 2, "comment": "c"}\n``` y', "no", None]
    df = spark.createDataFrame([(r,) for r in replies], "reply string").select(context.judgement(F.col("reply")).alias("g")).select("g.*")
    assert [r["relevance"] for r in df.collect()] == [5, 1, -1, -1]
    s = context.judge_summary(df).first()
    assert (s["n_valid"], s["n_failed"], s["relevance_mean"], s["overall_mean"], s["accuracy_2"]) == (2, 2, 3.0, 2.83, 1)
    assert context.judge_summary(df.limit(0)).first()["relevance_mean"] is None


def test_services(spark):
    df = spark.createDataFrame([(0, "a cat"), (1, None), (2, "a cat")], "caption_id bigint, caption string")
    got = {r["caption_id"]: np.array(r["embedding"]) for r in embeddings.extract(df, services.HashingEmbedder(16)).collect()}
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-5) and not got[1].any() and (got[0] == got[2]).all()
    prompts = spark.createDataFrame([(0, "q\n[1] (Score: 1.000) Caption: x"), (1, "nothing")], "q_id bigint, prompt string")
    assert {r["q_id"]: r["status"] for r in services.answered(prompts, services.TemplateGenerator()).collect()} == {0: "ok", 1: "empty"}


def test_translation_and_grading(spark):
    class Upper:
        def translate(self, texts):
            return [f"Translation: {t.upper()}" if "x" in t else "" for t in texts]

        def grade(self, prompts):
            return ['{"relevance": 3, "accuracy": 3, "usefulness": 4}' for _ in prompts]

    q = spark.createDataFrame([(0, "室外 x"), (1, "plain x"), (2, "室内"), (3, None)], "q_id bigint, text string")
    assert {r["q_id"]: r["text"] for r in services.translated(q, Upper()).collect()} == {0: "室外 X", 1: "plain x", 2: "室内", 3: None}
    answers = spark.createDataFrame([(0, "p", "a"), (1, "p", ""), (2, "p", None)], "q_id bigint, prompt string, answer string")
    assert {r["q_id"]: r["usefulness"] for r in services.graded(answers, Upper()).collect()} == {0: 4, 1: 1, 2: 1}


def test_captions_of_matches(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id bigint, embedding array<float>")
    texts = spark.createDataFrame([(0, i, f"c{i}") for i in range(5)], "id bigint, pos int, caption string")
    got = captions_of_matches(vectors.withColumnRenamed("id", "q_id"), vectors, texts, 2).collect()
    assert {(r["q_id"], r["rank"]): r["captions"] for r in got}[0, 1] == ["c0", "c1", "c2"] and len(got) == 4


def test_text_functions(spark):
    df = spark.createDataFrame([("  Über\tCAFÉ x ", "English translation: a dog"), ("", "translation:x"), (None, None)], "a string, b string")
    got = df.select(T.tokens(F.col("a")).alias("t"), T.without_label(F.col("b")).alias("w"), T.has_chinese(F.col("a")).alias("c")).collect()
    assert got[0]["t"] == ["über", "café", "x"] and got[0]["w"] == "a dog" and got[1]["t"] == [] and got[2]["t"] is None and not got[0]["c"]
    assert spark.range(1).select(T.path_of("dir$1/", F.lit(7), pad=5).alias("p")).first()["p"] == "dir$1/00007.jpg"


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.norm(F.col("a")).alias("n"), V.unit(F.col("z")).alias("u"), V.manhattan(F.col("a"), F.col("z")).alias("m"), V.euclidean(F.col("a"), F.col("z")).alias("e")).first()
    assert (r["n"], r["u"], r["m"], r["e"]) == (5.0, [0.0, 0.0], 7.0, 5.0)
    with pytest.raises(Exception, match="expected width 3"):
        df.select(V.checked(F.col("a"), 3)).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"annotations": [{"image_id": 1, "caption": "A cat!", "id": 10}, {"image_id": 1, "caption": "x", "id": 11}]}))
    rows = captions.nested_json(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in rows.orderBy("caption_id").collect()] == [(1, "A cat!", 10), (1, "x", 11)]
    assert [r["caption"] for r in captions.clean(rows).collect()] == ["a cat!"]
    (tmp_path / "c.tsv").write_text("image_id\tcaption\n1\ta|b\n")
    assert captions.delimited(spark, str(tmp_path / "c.tsv")).first()["caption"] == "a|b"
    (tmp_path / "t.csv").write_text("image,comment\nd/1.jpg,one\nd/2.jpg,two\n")
    (tmp_path / "img").mkdir()
    (tmp_path / "img/1.jpg").write_bytes(b"\xff\xd8")
    found = captions.images(spark, str(tmp_path / "img"))
    table = captions.caption_table(spark, str(tmp_path / "t.csv"), "img")
    assert {r["image_path"]: r["missing"] for r in captions.with_images(table, found).collect()} == {"img/1.jpg": False, "img/2.jpg": True}
    assert [r["image_id"] for r in captions.caption_table(spark, str(tmp_path / "t.csv"), "img", existing=found).collect()] == ["1"]
    assert captions.load(spark, "json", path=str(tmp_path / "absent"), fallback=True).count() == 30
    assert captions.demo(spark).groupBy("scene").count().count() == 3


def test_prepare(spark, tmp_path):
    rows = captions.demo(spark)
    counts = captions.prepare(rows, "images", str(tmp_path / "out"))
    assert sum(counts.values()) == 30 and set(counts) <= {"train", "val", "test"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, 0.25)], "name string, n int, x double")
    assert sinks.markdown(df, "name").first()["markdown"] == "| name | n | x |\n|---|---|---|\n| a | 1 | 0.2500 |\n| b | 2 | 0.5000 |"
    assert sinks.chart_rows(df, "name", ["n", "x"]).count() == 4
    sinks.to_json(df, str(tmp_path / "j"))
    sinks.to_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert sinks.to_numpy(df.orderBy("n"), ["n"])[0].tolist() == [1, 2]
    made = []
    for _ in range(2):
        embeddings.cached(spark, str(tmp_path / "cache"), {"dim": 4}, lambda: made.append(1) or df)
    assert len(made) == 1


def test_experiments(spark):
    x = np.eye(8) + 0.01
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    texts = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    pairs = spark.createDataFrame([(100 + i, i) for i in range(8)], "text_id bigint, image_id bigint")
    assert {r["direction"]: r["recall_1"] for r in experiments.both_directions(texts, images, pairs).collect()} == {"text_to_image": 1.0, "image_to_text": 1.0}
    q, gold = texts.withColumnRenamed("id", "q_id"), pairs.selectExpr("text_id AS q_id", "image_id AS id")
    assert {r["size"]: r["n_queries"] for r in experiments.scale(q, images, gold, (2, 8)).collect()} == {2: 2, 8: 8}
    assert {r["index"]: r["recall_10"] for r in experiments.ann_comparison(q, images, gold).collect()} == dict.fromkeys(("exact", "lsh", "ivfpq", "forest", "graph"), 1.0)
    assert [r["recall_1"] for r in experiments.reduction_comparison(q, images, gold, (7,)).collect()] == [1.0]


def test_stream(spark, tmp_path):
    from lodestone.streaming import answer_stream

    spark.createDataFrame([(0, "x")], "q_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q_id bigint, text string").parquet(str(tmp_path / "in"))
    run = answer_stream(stream, lambda q: q.withColumn("rank", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
