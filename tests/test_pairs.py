"""Searches and measures whose pairs grow with the square of a table: none of them may be rows that are exchanged."""

import numpy as np
import pytest

from lodestone.operators import dense
from lodestone.operators.ann import lsh


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    x[200:220] = x[7]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(3).cache()
    return vectors, vectors.where("id % 20 = 0").withColumnRenamed("id", "q_id"), x.astype(np.float64)


@pytest.mark.parametrize(("tables", "bits", "flips", "metric"), [(3, 2, 0, "cosine"), (2, 9, 0, "cosine"), (2, 9, 3, "manhattan"), (4, 3, 2, "dot"), (2, 12, 0, "euclidean")])
def test_hashed_search_makes_no_rows_of_pairs(spark, data, tables, bits, flips, metric):
    vectors, queries, x = data
    normals = lsh.planes(8, tables, bits)
    buckets = lsh.signatures(vectors, normals)
    found = lsh.search(queries, vectors, buckets, normals, 10, metric, flips=flips)
    assert not [line for line in planned(found).splitlines() if "Join Inner" in line and "signature" in line]
    met = {(r["q_id"], r["id"]) for r in lsh.candidates(queries, buckets, normals, flips).collect()}
    want = set()
    for q in range(0, 400, 20):
        scores = dense.similarity(x[q : q + 1], x, metric)[0]
        best = sorted((i for i in range(400) if (q, i) in met), key=lambda i: (-round(scores[i], 9), i))[:10]
        want |= {(q, i, n + 1, round(scores[i], 6)) for n, i in enumerate(best)}
    assert {(r["q_id"], r["id"], r["rank"], round(r["score"], 6)) for r in found.collect()} == want


def test_a_query_that_meets_buckets_of_some_tables_only(data):
    vectors, queries, _ = data
    normals = lsh.planes(8, 3, 2)
    some = lsh.signatures(vectors, normals).where("table_id = 1 AND id < 300")
    met = {(r["q_id"], r["id"]) for r in lsh.candidates(queries, some, normals).collect()}
    found = lsh.search(queries, vectors, some, normals, 400).select("q_id", "id").collect()
    assert met and {tuple(r) for r in found} == met and len(found) == len(met)


@pytest.mark.parametrize(("tables", "bits", "flips", "metric", "sent"), [(3, 2, 0, "cosine", 5), (3, 2, 0, "cosine", 100), (2, 9, 3, "manhattan", 5), (4, 3, 2, "dot", 5)])
def test_hashed_index_exchanges_no_vectors_and_k_rows_a_query_and_task(spark, data, monkeypatch, tmp_path, tables, bits, flips, metric, sent):
    from lodestone.operators.ann.index import VectorIndex

    for name, size in (("QUERY_BLOCK", 8), ("VECTOR_BLOCK", 16), ("SENT_QUERIES", sent)):
        monkeypatch.setattr(dense, name, size)
    vectors, queries, x = data
    index = VectorIndex.build(vectors, "lsh", f"{tmp_path}/index", tables=tables, bits=bits)
    found = index.search(queries, 3, metric=metric, flips=flips)
    assert not [line for line in planned(found).splitlines() if "Join Inner, (id" in line]
    met = {(r["q_id"], r["id"]) for r in lsh.candidates(queries, lsh.signatures(vectors, index.arrays["normals"]), index.arrays["normals"], flips).collect()}
    want = set()
    for q in range(0, 400, 20):
        scores = dense.similarity(x[q : q + 1], x, metric)[0]
        best = sorted((i for i in range(400) if (q, i) in met), key=lambda i: (-round(scores[i], 9), i))[:3]
        want |= {(q, i, n + 1, round(scores[i], 6)) for n, i in enumerate(best)}
    assert {(r["q_id"], r["id"], r["rank"], round(r["score"], 6)) for r in found.collect()} == want
    own = spark.read.parquet(f"{tmp_path}/index/vectors")
    left = lsh._scored(queries, own, own, index.arrays["normals"], 3, metric, flips)
    # Of each task, and not of each of the 25 blocks of vectors and more.
    assert max(r["count"] for r in left.groupBy("q_id").count().collect()) <= 3 * min(3, own.rdd.getNumPartitions())
    every = lsh.search_numbered(queries, own, index.arrays["normals"], 200_000, metric, flips=flips)  # more than a task keeps
    assert {(r["q_id"], r["id"]) for r in every.collect()} == met


def test_the_best_so_far_are_those_of_all_blocks():
    rng = np.random.default_rng(2)
    q, m = rng.integers(-3, 4, (9, 4)).astype(float), rng.integers(-3, 4, (300, 4)).astype(float)
    m[[5, 140, 290]] = np.nan
    ids, probes, have = rng.permutation(300), rng.integers(0, 3, (9, 2, 1)), rng.integers(0, 3, (300, 2))
    probes[8], have[250, 1] = 7, 7  # a query that meets one vector
    best = lsh._Best(np.arange(9), q, probes, 6, "dot")
    for i in range(0, 300, 20):
        best.meet(ids[i : i + 20], m[i : i + 20], have[i : i + 20])
    s = q @ m.T
    for r in range(9):
        meets = [i for i in range(300) if (probes[r, :, 0] == have[i]).any()]
        meets.sort(key=lambda i: (-np.inf if np.isnan(s[r, i]) else -s[r, i], ids[i]))
        assert best.id[best.row == r].tolist() == ids[meets[:6]].tolist() != []


def test_parts_bound_what_is_exchanged():
    for n, cores in ((10**6, 8), (10**6, 1000), (10**9, 1000)):
        parts, groups = dense.dealt(n // 20, n, 10, 64, cores)
        assert parts * (n // 20) * 10 * dense.ROW_BYTES <= n * 64 * 4 / 2
        assert parts * groups >= cores and n // 20 / groups <= dense.TASK_QUERIES


def test_an_index_with_a_table_of_buckets_is_still_read(spark, data, tmp_path):
    from lodestone.operators.ann import base
    from lodestone.operators.ann.index import VectorIndex

    vectors, queries, _ = data
    some, normals = vectors.where("id < 300"), lsh.planes(8, 3, 2)
    some.write.parquet(f"{tmp_path}/old/vectors")
    base.save({"buckets": lsh.signatures(some, normals)}, f"{tmp_path}/old", {"normals": normals}, kind="lsh", width=8, n=300)
    old = VectorIndex(spark, f"{tmp_path}/old").add(vectors)
    new = VectorIndex.build(some, "lsh", f"{tmp_path}/new", tables=3, bits=2).add(vectors)
    rows = lambda index: sorted((r["q_id"], r["rank"], r["id"], round(r["score"], 9)) for r in index.search(queries, 5).collect())
    assert old.manifest["n"] == new.manifest["n"] == 400 and rows(old) == rows(new) and len(rows(new)) == 100


def test_all_pairs_are_not_exchanged(spark, data):
    vectors, queries, x = data
    from lodestone.plans import catalog

    found = dense.every_pair(queries, vectors)
    got = {(r["q_id"], r["id"]): r["score"] for r in found.collect()}
    want = dense.similarity(x[::20], x, "cosine")
    assert len(got) == 20 * 400 and all(abs(want[q // 20, i] - s) < 1e-9 for (q, i), s in got.items())
    matrix = catalog.queries()["similarity_matrix"](spark, "/root/testdata/sf0.001")
    assert "Window" not in planned(matrix) and "rank" not in planned(matrix)


def test_all_pairs_of_two_blocks_come_by_score(spark, data, monkeypatch):
    vectors, queries, x = data
    monkeypatch.setattr(dense, "PAIR_BLOCK", 150)
    monkeypatch.setattr(dense, "SLICE", 37)
    holed = vectors.unionByName(spark.createDataFrame([(400, [float("nan")] * 8), (401, [0.0] * 8), (402, None)], vectors.schema)).coalesce(1)
    parts = [[tuple(r) for r in part] for part in dense.every_pair(queries.coalesce(1), holed, places=3).rdd.glom().collect()]
    scores = [s for part in parts for _, _, s in part]
    assert sum(a > b for a, b in zip(scores, scores[1:], strict=False)) == 2  # three blocks
    want = np.round(dense.similarity(x[::20], np.vstack([x, np.zeros((1, 8))]), "cosine"), 3)
    got = {(q, i): s for part in parts for q, i, s in part}
    assert len(scores) == len(got) == 20 * 401 and (7, 400) not in got
    assert all(abs(want[q // 20, i - (i == 401)] - s) < 1e-9 for (q, i), s in got.items())


def test_all_pairs_take_half_the_bytes_when_written(spark, tmp_path):
    from pyspark.sql import functions as F

    vectors = spark.range(8192, numPartitions=1).select("id", F.array(*[F.randn(i).cast("float") for i in range(64)]).alias("embedding"))
    dense.every_pair(vectors.where("id < 512").withColumnRenamed("id", "q_id"), vectors, places=6).write.parquet(f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 512 * 8192
    assert sum(f.stat().st_size for f in (tmp_path / "all").glob("*.parquet")) < 5 * 512 * 8192  # 9.2 before


def test_rounding_in_a_task_is_that_of_sql(spark):
    from pyspark.sql import functions as F

    x = [0.5, -0.5, 1.5, 2.5, 0.0, -0.0, 0.1234565, -0.1234565, 0.49999999999999994e-6, 1.0, -1e-9, 0.9999999, 123456.7890625, *np.random.default_rng(3).normal(size=2000).tolist()]
    for places in (0, 6):
        want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", places)).collect()]
        got = dense.rounded(np.array(x), places)
        assert got.tolist() == want and not np.signbit(got[got == 0]).any()
    assert dense.rounded(np.array([1e305, -np.inf]), 6).tolist() == [1e305, -np.inf]


def test_classes_measure_as_their_pairs_do(spark):
    from lodestone.operators import metrics

    rows = [(i, i % 3) for i in range(30)] + [(30, None), (31, 7), (4, 2), (5, 2), (5, 0)]
    items = spark.createDataFrame(rows, "id bigint, label int")
    asked = items.where("id % 2 = 0 OR id = 31 OR id = 5").withColumnRenamed("id", "q_id").unionByName(spark.createDataFrame([(99, 1), (98, 55)], "q_id bigint, label int"))
    pairs = asked.join(items, "label").where("q_id <> id").select("q_id", "id")
    preds = spark.createDataFrame([(q, r, (q * 7 + r * r) % 33) for q in [*range(0, 31, 3), 99, 98, 31, 5, 4] for r in range(1, 8)], "q_id bigint, rank int, id bigint")
    gold = metrics.Classes(asked, items)
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(metrics.per_query(preds, gold)) == order(metrics.per_query(preds, pairs)) != []
    assert order(metrics.summary(preds, gold))[0] == pytest.approx(order(metrics.summary(preds, pairs))[0])
    assert order(metrics.judged(preds, gold)) == order(metrics.judged(preds, pairs))


def test_compared_indexes_leave_only_what_they_found(spark, data):
    from lodestone.operators.ann.index import timed_comparison
    from lodestone.session import folders_since

    before = set(folders_since())
    found = timed_comparison(data[0], data[1], {"flat": {}, "lsh": {"tables": 3, "bits": 2}, "forest": {"trees": 3}}, 5)
    assert len(set(folders_since()) - before) == len(found) == 3
    assert [got.count() for got, _, _ in found.values()] == [100, 100, 100]


def test_candidates_are_exchanged_once_and_vectors_not_for_each_pair(spark, data):
    from lodestone.operators.ann import base

    found = base.ranked(data[1], data[1].crossJoin(data[0].select("id")).select("q_id", "id"), data[0], 5)
    wide = [line for line in planned(found).splitlines() if "Join Inner, (q_id" in line]
    assert wide and all("rightHint=(strategy=broadcast)" in line or "broadcast" in line for line in wide)


def test_a_document_adds_its_scores_up_where_it_is(spark, tmp_path):
    import re

    from lodestone.operators import bm25

    docs = spark.createDataFrame([(i, f"the w{i % 7} of w{i % 3}") for i in range(60)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(q, f"the of w{q}") for q in range(5)], "q_id bigint, text string")
    bm25.build(docs).save(f"{tmp_path}/index")
    found = bm25.scores(bm25.Bm25Index.load(spark, f"{tmp_path}/index"), asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(q_id#\d+L?, doc_id", plan)
    assert found.count() == 5 * 60


def test_captions_that_nobody_found_stay_where_they_are(spark):
    from lodestone.operators import context

    results = spark.createDataFrame([(0, 1, 3, 0.5), (0, 2, 99, 0.25), (1, 1, 4, 0.5)], "q_id bigint, rank int, id bigint, score double")
    told = context.context(results, spark.createDataFrame([(i, f"c{i}") for i in range(10)], "id bigint, caption string"))
    assert [line for line in planned(told).splitlines() if "Join Inner, (id" in line and "broadcast" in line]
    assert {tuple(r) for r in told.collect()} == {(0, "[1] (Score: 0.500) Caption: c3\n[2] (Score: 0.250)"), (1, "[1] (Score: 0.500) Caption: c4")}


def test_words_are_counted_before_they_are_exchanged(spark, tmp_path, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from lodestone.operators import bm25

    monkeypatch.setattr(bm25, "PIECE_WORDS", 30)
    texts = [("a", "the the cat the"), ("b", None), ("c", ""), ("a", "the dog sat by"), ("d", "dog " * 50), ("e", "Ünï the 猫"), *((f"x{i}", f"the w{i % 3} the") for i in range(40))]
    index = bm25.build(spark.createDataFrame(texts, "doc_id string, text string").coalesce(2))
    lists = bm25.counted(index.words.withColumn("part", F.lit(0)))
    assert lists.where("term = 'the'").count() < 15 and lists.where("term = 'the'").agg(F.sum(F.aggregate("tf", F.lit(0), lambda s, x: s + x))).first()[0] == 85
    index.save(f"{tmp_path}/index")
    got = {(r["term"], r["doc_id"]): (r["tf"], r["dl"]) for r in bm25.Bm25Index.load(spark, f"{tmp_path}/index").postings.collect()}
    want = Counter((w, d) for d, t in texts for w in (t or "").lower().split())
    assert {k: tf for k, (tf, _) in got.items()} == dict(want) and got["the", "a"] == (4, 4) and got["dog", "d"] == (50, 50)
    zeros = bm25.topk(index, spark.createDataFrame([(0, "cat"), (1, "nothing")], "q_id bigint, text string"), 3, fill_zero=True)
    assert zeros.groupBy("q_id").count().where("count = 3").count() == 2
