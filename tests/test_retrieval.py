import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, lists_for, trees_for
from lodestone.operators import bm25, dense, fusion, metadata, ranking, router
from lodestone.operators.retrieve import STRATEGIES, Held, Retriever

DOCS = [(0, "The river runs past the mill"), (1, "rain fell on the mill all night"), (2, "Bread needs flour and time"), (3, "the old baker slept past noon")]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(DOCS, "doc_id bigint, text string"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")


def test_corpus_figures(index):
    assert tuple(index.stats.first()) == (4, 6.0)
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["river"] == pytest.approx(1.2039728043) and idf["the"] == pytest.approx(0.3566749439)


def test_scores_and_repeats(spark, index):
    got = {(r["q_id"], r["id"]): r["score"] for r in bm25.scores(index, asked(spark, "river on mill", "the the", "", "zzz")).collect()}
    assert got[0, 0] > got[0, 1] > 0 and (0, 2) not in got
    once = {r["id"]: r["score"] for r in bm25.scores(index, asked(spark, "the")).collect()}
    assert all(got[1, d] == pytest.approx(2 * s) for d, s in once.items())
    assert not [q for q, _ in got if q > 1]


def test_zero_fill_and_k_beyond_n(spark, index):
    filled = bm25.topk(index, asked(spark, "river"), 3, fill_zero=True).orderBy("rank").collect()
    assert [r["id"] for r in filled] == [0, 1, 2] and filled[1]["score"] == 0
    assert bm25.topk(index, asked(spark, "river"), 9).count() == 1


def test_index_survives_storage(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = bm25.Bm25Index.load(spark, str(tmp_path))
    q = asked(spark, "the river")
    assert bm25.topk(again, q, 4).orderBy("rank").collect() == bm25.topk(index, q, 4).orderBy("rank").collect()


def test_null_and_empty_documents(spark):
    built = bm25.build(spark.createDataFrame([(0, None), (1, ""), (2, "a b")], "doc_id bigint, text string"))
    assert tuple(built.stats.first()) == (3, pytest.approx(2 / 3))


@pytest.mark.parametrize("metric", dense.METRICS)
def test_exact_search_is_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 33)
    x = np.random.default_rng(0).normal(size=(200, 16)).astype(np.float32)
    x[5] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    q = vectors.where("id % 10 = 0").withColumnRenamed("id", "q_id")
    got = dense.exact_topk(q, vectors, 5, metric).collect()
    s = dense.similarity(x.astype(float), x.astype(float), metric)
    for r in got:
        assert r["score"] == pytest.approx(s[r["q_id"], r["id"]])
        assert r["id"] == np.lexsort((np.arange(200), -np.round(s[r["q_id"]], 9)))[r["rank"] - 1]
    assert len(got) == 20 * 5
    with pytest.raises(ValueError):
        dense.exact_topk(q, vectors, 5, "hamming")


def test_filters(spark):
    df = spark.createDataFrame([(1, 2021, "outdoor"), (2, None, "indoor"), (3, 2023, None)], "id bigint, year int, scene string")
    ids = lambda *c: {r["id"] for r in metadata.filtered(df, [dict(zip(("field", "op", "value"), x)) for x in c]).collect()}
    assert ids(("year", "neq", 2021)) == {2, 3}
    assert ids(("year", "gte", 2021), ("year", "lt", 2023)) == {1}
    assert ids(("scene", "contains", "door")) == {1, 2}
    assert ids(("year", "in", 2023)) == {3} and ids(("year", "in", [2021, 2023])) == {1, 3}
    assert ids(("nothing", "eq", 1), ("year", "unknown", 1)) == {1, 2, 3}


def test_parsed_ranges(spark):
    got = {r["text"]: [(c["field"], c["op"], c["value"]) for c in r["c"]] for r in asked(spark, "before 1999", "outdoor since 2020", None).select("text", metadata.parsed(F.col("text"), ranges=True).alias("c")).collect()}
    assert got == {"before 1999": [("year", "lt", "1999")], "outdoor since 2020": [("year", "gte", "2020"), ("scene", "eq", "outdoor")], None: []}


# Fixed values of this and the next test: sentences and scores whose weights and sums are worked out by hand.
def test_router_goldens(spark):
    got = {r["q_id"]: r for r in router.routed(asked(spark, "outdoor photos from 2023", "a peaceful sunset over the ocean", "")).collect()}
    assert [got[0][c] for c in ("w_dense", "w_sparse", "w_meta")] == pytest.approx([0.5, 0.15, 0.35]) and got[0]["query_type"] == "metadata"
    assert [got[1][c] for c in ("w_dense", "w_sparse", "w_meta")] == pytest.approx([0.6, 0.25, 0.15]) and got[1]["query_type"] == "semantic"
    assert got[2]["query_length"] == 0


def test_router_lattice(spark):
    rows = [(i, float(5 * rare), int(f > 0), int(f > 1), int(f > 2), 9 * long, neg) for i, (rare, f, long, neg) in enumerate((a, b, c, d) for a in (0, 1) for b in range(4) for c in (0, 1) for d in (0, 1))]
    df = spark.createDataFrame(rows, "i int, avg_idf double, has_temporal int, has_location int, has_category int, query_length int, has_negation int")
    got = df.select("*", router.query_class().alias("kind"), *router.weights()).collect()
    assert len(got) == 32
    for r in got:
        f, rare, long, neg = r["has_temporal"] + r["has_location"] + r["has_category"], r["avg_idf"] > 4, r["query_length"] > 6, r["has_negation"]
        assert r["w_dense"] == pytest.approx(0.6 - 0.1 * rare - 0.05 * f + 0.1 * long - 0.1 * neg)
        assert r["w_sparse"] == pytest.approx(0.25 + 0.15 * rare - 0.05 * f - 0.05 * long + 0.1 * neg)
        assert r["w_dense"] + r["w_sparse"] + r["w_meta"] == pytest.approx(1) and min(r["w_dense"], r["w_sparse"], r["w_meta"]) > 0


def test_fusion_goldens(spark):
    # Scores and ranks of four items.
    df = spark.createDataFrame([(0, i, d, s) for i, (d, s) in enumerate(zip([0.8, 0.3, 0.1, 0.9], [0.2, 0.9, 0.1, 0.3]))], "q_id bigint, id bigint, dense double, sparse double")
    got = [r["score"] for r in fusion.weighted(df, 0.7, 0.3).orderBy("id").collect()]
    assert got == pytest.approx([0.65, 0.475, 0, 0.775])
    ranks = lambda ids: spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], "q_id bigint, id bigint, rank int")
    rrf = {r["id"]: r["score"] for r in fusion.rrf([ranks([1, 2, 3]), ranks([2, 3, 1])]).collect()}
    assert rrf == pytest.approx({2: 0.0325224749, 1: 0.0322664585, 3: 0.0320020481})


def test_calibration(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 3.0, 10.0)] + [(1, 5.0), (1, 5.0)], "q_id bigint, x double")
    z = [r["x_cal"] for r in fusion.calibrated(df, ["x"], "zscore").where("q_id = 0").orderBy("x").collect()]
    assert z == pytest.approx([-0.8485281374, -0.5656854249, -0.2828427125, 1.6970562748])
    assert {r["x_cal"] for m in ("minmax", "zscore") for r in fusion.calibrated(df, ["x"], m).where("q_id = 1").collect()} == {0.0}
    with pytest.raises(ValueError):
        fusion.calibrated(df, ["x"], "other")


@pytest.fixture(scope="module")
def retriever(spark, index):
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id bigint, embedding array<float>")
    items = spark.createDataFrame([(0, 2023, "outdoor"), (1, 2020, "indoor")], "id bigint, year int, scene string")
    return Retriever(vectors, index, items)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies(spark, retriever, strategy):
    q = spark.createDataFrame([(0, "outdoor river from 2023", [1.0, 0.1, 0.0, 0.0]), (1, "the rain", [0.0, 1.0, 0.0, 0.0])], "q_id bigint, text string, embedding array<float>")
    got = retriever.search(q, 2, strategy).orderBy("q_id", "rank").collect()
    assert [r["id"] for r in got if r["rank"] == 1] == [0, 1]
    assert [r["rank"] for r in got if r["q_id"] == 1][:2] == [1, 2]
    if strategy == "adaptive":
        assert got[0]["query_type"] == "metadata" and sum(got[0]["weights"]) == pytest.approx(1)


def test_held_candidates_change_nothing(spark, retriever):
    q = spark.createDataFrame([(0, "outdoor river from 2023", [1.0, 0.1, 0.0, 0.0]), (1, "the rain", [0.0, 1.0, 0.0, 0.0]), (2, "nothing", None)], "q_id bigint, text string, embedding array<float>")
    held = Held.of(retriever, q, 3)
    for strategy in STRATEGIES:  # multi_stage wants more than is held
        for n in (3, 4):
            asked = lambda r, strategy=strategy, n=n: r.search(q, 2, strategy, n).orderBy("q_id", "rank").collect()
            assert asked(held) == asked(retriever)


def test_unknown_strategy(spark, retriever):
    with pytest.raises(ValueError):
        retriever.search(asked(spark, "x"), strategy="other")


def test_order_does_not_depend_on_partitions(spark, index):
    q = asked(spark, "the river", "flour on the mill")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(bm25.topk(index, q, 4).orderBy("q_id", "rank").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_dense_index_and_splits(spark):
    df = spark.createDataFrame([(f"k{i % 50:02d}", i) for i in range(200)], "key string, n int")
    assert [r["idx"] for r in ranking.dense_index(df, "key").orderBy("key").collect()] == list(range(50))
    split = ranking.group_split(df, "key")
    assert split.groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split.repartition(7).orderBy("n").collect() == split.orderBy("n").collect()
    assert ranking.hash_sample(df, "n", 10).collect() == ranking.hash_sample(df.repartition(5), "n", 10).collect()


def test_parameters():
    assert (lists_for(100), lists_for(29_000), trees_for(100), trees_for(29_000)) == (10, 400, 15, 50)
    assert DEFAULT.weights == (0.6, 0.25, 0.15) and dense.memory_mb(2**18, 4) == 4.0
    assert math.isclose(sum(DEFAULT.weights), 1)
