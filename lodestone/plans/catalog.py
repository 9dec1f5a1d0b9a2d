"""All queries of the library proper, by name. Each runs over whole tables; the SQL beside it is independent of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import bm25, context, dense, fusion, metadata, metrics, ranking, router
from lodestone.operators import reduce as reduction
from lodestone.operators.ann import forest, graph, ivf, lsh
from lodestone.operators.retrieve import Retriever
from lodestone.plans import sql as S
from lodestone.session import discard, shared_folder, spread, stored, table
from lodestone.sources import captions, sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def oracle_of(name: str) -> str:
    return _SQL[name]


def _all() -> None:
    """The other modules' queries register when they are imported."""
    from lodestone.plans import catalog_indexes, catalog_learned, catalog_requests, catalog_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _places(digits: int, *names: str) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# Captions: cleaning, paths, groups, samples and splits.


@query(S.CLEAN)
def clean_captions(spark, d):
    return captions.clean(_documents(spark, d).select("doc_id", F.col("text").alias("caption")))


@query("SELECT doc_id, 'images/' || doc_id || '.jpg' AS image_path FROM documents")
def image_path_concat(spark, d):
    return table(spark, d, "documents").select("doc_id", T.path_of("images", F.col("doc_id")).alias("image_path"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def first_caption_per_group(spark, d):
    return ranking.first_of_group(table(spark, d, "conversations"), "conv_id", "text", "turn")


@query("SELECT conv_id, turn, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) WHERE pos <= 3")
def top3_captions_per_group(spark, d):
    return ranking.head_of_group(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", *_long("pos"), "text")


@query("SELECT conv_id, count(*) AS n, string_agg(text, '|' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def caption_list_per_group(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["text"]), "|").alias("texts"))


@query("SELECT url, row_number() OVER (ORDER BY url) - 1 AS idx FROM (SELECT DISTINCT url FROM pages)")
def item_dense_index(spark, d):
    return ranking.dense_index(table(spark, d, "pages"), "url")


@query("SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def distinct_and_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("lang").alias("n_langs"))


@query(f"SELECT doc_id, CASE WHEN s < 0.1 THEN 'test' WHEN s < 0.1 + 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {S.share('doc_id')} AS s FROM documents)")
def group_hash_split(spark, d):
    return ranking.group_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def hash_sample(spark, d):
    return ranking.hash_sample(table(spark, d, "documents"), "doc_id", 100).select("doc_id", "lang")


@query("SELECT doc_id, regexp_matches(text, '[一-鿿]') AS chinese FROM documents")
def chinese_flag(spark, d):
    return _documents(spark, d).select("doc_id", T.has_chinese(F.col("text")).alias("chinese"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def path_basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


# BM25.


def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


#: Folders of the indexes that a session has built, by what they were built from.
_built: dict[tuple, str] = {}


def _kept(spark, d, name: str, source: str, write: Callable[[str], None]) -> str:
    """The folder of an index, which is built once in a session for each state of its table: all paths, sizes, times and rows."""
    part = lambda c: F.col(f"_metadata.file_{c}").alias(c)
    files = table(spark, d, source).select(part("path"), part("size"), part("modification_time")).groupBy("path", "size", "modification_time").agg(F.count("*").alias("n"))
    state = files.agg(F.bit_xor(F.xxhash64("path", "size", "modification_time", "n")), F.count("*"), F.sum("n")).first()
    index = (spark.sparkContext.applicationId, d, name)
    key = (*index, *state)
    if key not in _built:
        path = shared_folder(spark)
        write(path)
        _built[key] = path
        # Of an index one older state stays, as what was asked of it may still be read.
        for old in [k for k in _built if k[:3] == index][:-2]:
            gone = _built.pop(old)
            _read.pop(gone, None)
            discard(gone)
    return _built[key]


#: The BM25 indexes of the session that were read again, by folder.
_read: dict[str, bm25.Bm25Index] = {}


def _index(spark, d) -> bm25.Bm25Index:
    path = _kept(spark, d, "bm25", "documents", lambda path: bm25.build(_documents(spark, d)).save(path))
    if path not in _read:
        _read[path] = bm25.Bm25Index.load(spark, path)
    return _read[path]


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def _repeats(spark) -> DataFrame:
    return spark.createDataFrame([(0, "the the"), (1, "the of the of of"), (2, "que la la"), (3, "zzzunknown the"), (4, "")], "q_id bigint, text string")


@query(f"WITH {S.TOKENS} SELECT d.doc_id, count(term) AS n_tokens, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id")
def token_stats(spark, d):
    words = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
    return _documents(spark, d).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"WITH {S.INDEX} SELECT term, df FROM df")
def term_doc_freq(spark, d):
    return _index(spark, d).terms.select("term", "df")


@query(f"WITH {S.INDEX} SELECT term, round(idf, 9) AS idf FROM idf")
def idf_table(spark, d):
    return _index(spark, d).terms.select("term", *_places(9, "idf"))


@query(f"WITH {S.INDEX} SELECT term, doc_id, tf FROM tf")
def postings(spark, d):
    return bm25.build(_documents(spark, d)).postings.select("term", "doc_id", "tf")


@query(f"WITH {S.INDEX}, {S.BENCHMARK_TERMS}, {S.BM25} SELECT q_id, id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, d):
    return bm25.scores(_index(spark, d), _asked(spark, d)).select("q_id", "id", *_places(6, "score"))


@query(f"WITH {S.INDEX}, {S.BENCHMARK_TERMS}, {S.BM25} {S.top('bm', 10)}")
def bm25_topk(spark, d):
    return bm25.topk(_index(spark, d), _asked(spark, d), 10).select("q_id", "id", *_places(6, "score"), *_long("rank"))


@query(f"WITH {S.INDEX}, {S.terms_of(S.REPEATS)}, {S.BM25} {S.top('bm', 10)}")
def bm25_repeat_terms(spark, d):
    return bm25.topk(_index(spark, d), _repeats(spark), 10).select("q_id", "id", *_places(6, "score"), *_long("rank"))


# Vectors.


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _vector_queries(spark, d) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return _vectors(spark, d).where(F.col("id") % 20 == 0).withColumnRenamed("id", "q_id")


@query(f"SELECT vec_id, round(sqrt(list_inner_product({S.V}, {S.V})), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT vec_id, pos, round(x / n, 6) AS x FROM (SELECT vec_id, sqrt(list_inner_product({S.V}, {S.V})) + 1e-10 AS n, unnest({S.V}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", *_long("pos"), *_places(6, "x"))


@query(f"WITH {S.VECTORS} SELECT q_id, id, round(cosine, 6) AS score FROM sims")
def similarity_matrix(spark, d):
    return dense.every_pair(_vector_queries(spark, d), _vectors(spark, d), places=6)


def _topk(metric: str):
    def run(spark, d):
        return dense.exact_topk(_vector_queries(spark, d), _vectors(spark, d), 10, metric).select("q_id", "id", *_places(6, "score"), *_long("rank"))

    run.__name__ = f"dense_topk_{metric}"
    return query(f"WITH {S.VECTORS}, s AS (SELECT q_id, id, {metric} AS score FROM sims) {S.top('s', 10)}")(run)


for _metric in dense.METRICS:
    _topk(_metric)


@query(f"SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest({S.V}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def centroid_by_label(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label"), F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", *_long("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


# Filters on metadata.


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def _filter(name: str, where: str, *conditions: tuple):
    def run(spark, d):
        return metadata.filtered(_labelled(spark, d), [dict(zip(("field", "op", "value"), c, strict=True)) for c in conditions]).select("doc_id", "lang", "n_chars", "toxic")

    run.__name__ = name
    query(f"SELECT doc_id, lang, n_chars, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE {where}")(run)


_filter("filter_eq", "lang = 'en'", ("lang", "eq", "en"))
_filter("filter_neq_null", "toxic IS DISTINCT FROM 0", ("toxic", "neq", 0))
_filter("filter_range", "n_chars >= 500 AND n_chars < 3000", ("n_chars", "gte", 500), ("n_chars", "lt", 3000))
_filter("filter_open_range", "n_chars > 1000 AND n_chars <= 9000", ("n_chars", "gt", 1000), ("n_chars", "lte", 9000))
_filter("filter_in", "source IN ('src1', 'src7', 'src19')", ("source", "in", ["src1", "src7", "src19"]))
_filter("filter_contains", "contains(source, '1')", ("source", "contains", "1"))
_filter("filter_conjunction", "lang = 'fr' AND n_chars > 1000 AND quality = 1", ("lang", "eq", "fr"), ("n_chars", "gt", 1000), ("quality", "eq", 1), ("unknown", "eq", 1), ("lang", "like", "x"))


def _spoken(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(S.SPOKEN)), "q_id bigint, text string")


def _everything_asked(spark, d) -> DataFrame:
    return _spoken(spark).unionByName(_asked(spark, d).withColumn("q_id", F.col("q_id") + 1000))


def _scenes(spark, d) -> DataFrame:
    """Documents as items with a year and a scene."""
    scene = F.when(F.col("doc_id") % 3 == 0, "outdoor").when(F.col("doc_id") % 3 == 1, "indoor")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (2020 + F.col("doc_id") % 6).alias("year"), scene.alias("scene"))


@query(f"WITH {S.EVERYTHING}, {S.PARSED} SELECT * FROM parsed")
def parse_query_metadata(spark, d):
    return _everything_asked(spark, d).select("q_id", F.explode(metadata.parsed(F.col("text"))).alias("c")).select("q_id", "c.field", "c.op", "c.value")


@query(f"WITH {S.SPOKEN_ONLY}, {S.PARSED}, {S.META} SELECT q_id, id, meta FROM meta")
def metadata_score(spark, d):
    return metadata.scores(_spoken(spark), _scenes(spark, d))


# Routing.


@query(f"WITH {S.INDEX}, {S.EVERYTHING}, {S.ROUTER} SELECT q_id, query_length, has_temporal, has_location, has_category, has_negation, round(avg_idf, 6) AS avg_idf FROM feat")
def router_features(spark, d):
    found = router.features(_everything_asked(spark, d), _index(spark, d).terms)
    return found.select("q_id", *_long("query_length", "has_temporal", "has_location", "has_category", "has_negation"), *_places(6, "avg_idf"))


@query(f"WITH {S.INDEX}, {S.EVERYTHING}, {S.ROUTER} SELECT q_id, query_type FROM routed")
def router_class(spark, d):
    return router.routed(_everything_asked(spark, d), _index(spark, d).terms).select("q_id", "query_type")


@query(f"WITH {S.INDEX}, {S.EVERYTHING}, {S.ROUTER} SELECT q_id, round(w_dense, 6) AS w_dense, round(w_sparse, 6) AS w_sparse, round(w_meta, 6) AS w_meta FROM routed")
def router_weights(spark, d):
    return router.routed(_everything_asked(spark, d), _index(spark, d).terms).select("q_id", *_places(6, "w_dense", "w_sparse", "w_meta"))


# Fusion and strategies: query i has the text of benchmark item i and the vector i; document and vector ids are the same.


def _retriever(spark, d, items: bool = False) -> Retriever:
    return Retriever(_vectors(spark, d), _index(spark, d), _scenes(spark, d) if items else None)


def _hybrid_queries(spark, d) -> DataFrame:
    return _asked(spark, d).join(_vectors(spark, d).withColumnRenamed("id", "q_id"), "q_id")


def _aligned(spark, d) -> DataFrame:
    return _retriever(spark, d).candidates(_hybrid_queries(spark, d), 200)


_HYBRID = f"WITH {S.INDEX}, {S.BENCHMARK_TERMS}, {S.BM25}, {S.HYBRID}"


@query(f"{_HYBRID}, {S.aligned(200)} SELECT q_id, id, round(dense, 6) AS dense, round(sparse, 6) AS sparse FROM al")
def align_outer(spark, d):
    return _aligned(spark, d).select("q_id", "id", *_places(6, "dense", "sparse"))


@query(f"{_HYBRID}, {S.aligned(200)}, {S.NORMAL} SELECT q_id, id, round(0.6 * nd + 0.25 * ns, 6) AS score FROM nm")
def fuse_minmax_weighted(spark, d):
    return fusion.weighted(_aligned(spark, d), 0.6, 0.25).select("q_id", "id", *_places(6, "score"))


@query(f"{_HYBRID}, {S.aligned(200)}, {S.NORMAL} SELECT q_id, id, round(nd, 6) AS dense_cal, round(ns, 6) AS sparse_cal FROM nm")
def calibrate_minmax(spark, d):
    return fusion.calibrated(_aligned(spark, d), ["dense", "sparse"]).select("q_id", "id", *_places(6, "dense_cal", "sparse_cal"))


@query(f"{_HYBRID}, {S.aligned(200)}, {S.ZSCORE} SELECT q_id, id, round(zd, 6) AS dense_cal, round(zs, 6) AS sparse_cal FROM zm")
def calibrate_zscore(spark, d):
    return fusion.calibrated(_aligned(spark, d), ["dense", "sparse"], "zscore").select("q_id", "id", *_places(6, "dense_cal", "sparse_cal"))


@query(f"{_HYBRID}, {S.rrf(200)} SELECT q_id, id, round(score, 9) AS score FROM rr")
def fuse_rrf(spark, d):
    asked, r = _hybrid_queries(spark, d), _retriever(spark, d)
    return fusion.rrf([r.dense(asked, 200), bm25.topk(r.index, asked, 200)]).select("q_id", "id", *_places(9, "score"))


@query(f"{_HYBRID}, {S.aligned(200)}, {S.NORMAL}, s AS (SELECT q_id, id, 0.6 * nd + 0.25 * ns AS score FROM nm) {S.top('s', 10)}")
def hybrid_fixed(spark, d):
    return _retriever(spark, d).search(_hybrid_queries(spark, d), 10, "fixed_weight").select("q_id", "id", *_places(6, "score"), *_long("rank"))


_ROUTED = f"WITH {S.INDEX}, {S.BENCHMARK_TERMS}, {S.BM25}, {S.HYBRID}, {S.aligned(200)}, {S.BENCHMARK_ASKED}, {S.ROUTER}"
_WEIGHTS = "round(w_dense, 6) AS w_dense, round(w_sparse, 6) AS w_sparse, round(w_meta, 6) AS w_meta"


def _routed_out(found: DataFrame) -> DataFrame:
    flat = found.select("q_id", "id", "score", "rank", "query_type", *[F.col(f"weights.{w}").alias(f"w_{w}") for w in ("dense", "sparse", "meta")])
    return flat.select("q_id", "id", *_places(6, "score"), *_long("rank"), "query_type", *_places(6, "w_dense", "w_sparse", "w_meta"))


@query(f"{_ROUTED}, {S.NORMAL}, s AS (SELECT q_id, id, w_dense * nd + w_sparse * ns AS score, query_type, w_dense, w_sparse, w_meta FROM nm JOIN routed USING (q_id)) {S.top('s', 10, f'query_type, {_WEIGHTS}')}")
def hybrid_adaptive(spark, d):
    return _routed_out(_retriever(spark, d).search(_hybrid_queries(spark, d), 10, "adaptive"))


@query(
    f"{_ROUTED}, {S.PARSED}, {S.META}, am AS (SELECT al.*, coalesce(meta, 0) AS meta FROM al LEFT JOIN meta USING (q_id, id)), {S.normal('am')}, s AS (SELECT q_id, id, w_dense * nd + w_sparse * ns + w_meta * nmeta AS score, query_type, w_dense, w_sparse, w_meta FROM nm JOIN routed USING (q_id)) {S.top('s', 10, f'query_type, {_WEIGHTS}')}"
)
def hybrid_adaptive_metadata(spark, d):
    return _routed_out(_retriever(spark, d, items=True).search(_hybrid_queries(spark, d), 10, "adaptive"))


@query(f"{_HYBRID}, {S.rrf(500)}, survivors AS (SELECT q_id, id FROM ({S.ranked('rr')}) WHERE rank <= 200), s AS (SELECT q_id, id, cosine AS score FROM survivors JOIN hs USING (q_id, id)) {S.top('s', 10)}")
def multi_stage(spark, d):
    return _retriever(spark, d).search(_hybrid_queries(spark, d), 10, "multi_stage").select("q_id", "id", *_places(6, "score"), *_long("rank"))


# Evaluation: vectors of the query's label are relevant, the query itself is left out.


def _label_gold(spark, d) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.where(F.col("id") % 20 == 0).withColumnRenamed("id", "q_id")
    return asked.join(labels, "label").where("q_id <> id").select("q_id", "id")


def _classes(spark, d) -> metrics.Classes:
    """As ``_label_gold``, without its pairs."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return metrics.Classes(labels.where(F.col("id") % 20 == 0).withColumnRenamed("id", "q_id"), labels)


def _label_preds(spark, d) -> DataFrame:
    return dense.exact_topk(_vector_queries(spark, d), _vectors(spark, d), 10, exclude_self=True)


def _measure(name: str, *columns: str):
    def run(spark, d):
        return metrics.summary(_label_preds(spark, d), _label_gold(spark, d)).select("n_queries", *_places(6, *columns))

    run.__name__ = name
    query(f"WITH {S.EVALUATION} SELECT n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM summary")(run)


_measure("recall_at_k", "recall_1", "recall_5", "recall_10")
_measure("precision_at_k", "precision_1", "precision_5", "precision_10")
_measure("map_retrieved", "map_retrieved")
_measure("map_all_relevant", "map_all")
_measure("mrr", "mrr")


@query(f"WITH {S.EVALUATION} SELECT q_id, hits1, hits5, hits10, round(rr, 6) AS rr, round(ap_all, 6) AS ap_all FROM per_query")
def multilabel_recall(spark, d):
    found = metrics.per_query(_label_preds(spark, d), _label_gold(spark, d))
    return found.select("q_id", *_long("hits1", "hits5", "hits10"), *_places(6, "rr", "ap_all"))


@query(S.LATENCY)
def latency_stats(spark, d):
    found = metrics.latency(table(spark, d, "events"), "value", "event_type")
    return found.select("event_type", "n", *_places(6, "mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms"))


@query(S.scale_recall((100, 250, 500)))
def scale_recall(spark, d):
    from lodestone.plans import experiments

    gold, have = _label_gold(spark, d), _vectors(spark, d)
    rows = experiments.scale(_vector_queries(spark, d), have, gold, experiments.sizes_of(have, (100, 250, 500)), 10)
    return rows.select(*_long("size"), "n_queries", *_places(6, "recall_10", "mrr"))


@query(S.ABLATION)
def strategy_ablation(spark, d):
    """Gold: documents that hold the benchmark text as it is."""
    from lodestone.plans import experiments

    asked = _hybrid_queries(spark, d)
    gold = experiments.verbatim_gold(_documents(spark, d).withColumnRenamed("doc_id", "id"), asked)
    return experiments.strategy_ablation(_retriever(spark, d), asked, gold).select("strategy", "n_queries", *_places(6, "recall_1", "recall_10", "mrr"))


# Context, prompts and judgements.


def _results(spark, d) -> DataFrame:
    return bm25.topk(_index(spark, d), _asked(spark, d), 10)


def _captions(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("caption"))


@query(f"WITH {S.CONTEXT} SELECT q_id, context FROM ctx")
def context_build(spark, d):
    return context.context(_results(spark, d), _captions(spark, d))


@query(f"WITH {S.CONTEXT} SELECT q_id, {S.quoted(context.RETRIEVAL.split('{query}')[0])} || text || {S.quoted(context.RETRIEVAL.split('{query}')[1].split('{context}')[0])} || context || {S.quoted(context.RETRIEVAL.split('{context}')[1])} AS prompt FROM ctx JOIN (SELECT item_id AS q_id, text FROM benchmark) USING (q_id)")
def prompt_render(spark, d):
    told = context.context(_results(spark, d), _captions(spark, d)).join(_asked(spark, d), "q_id")
    return told.select("q_id", context.retrieval_prompt(F.col("text"), F.col("context")).alias("prompt"))


def _replies(spark, d) -> DataFrame:
    """What a judge might have said of each labelled document."""
    grade = lambda add: (1 + (F.col("doc_id") + add) % 5).cast("string")
    body = F.concat(F.lit('{"relevance": '), grade(0), F.lit(', "accuracy": '), grade(1), F.lit(', "usefulness": '), grade(2), F.lit("}"))
    said = F.when(F.col("doc_id") % 7 == 0, "no grades").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, d, "labels").select("doc_id", "quality", said.alias("reply"))


@query(f"WITH {S.JUDGED} SELECT doc_id, relevance, accuracy, usefulness FROM judged")
def judge_parse(spark, d):
    return _replies(spark, d).select("doc_id", context.judgement(F.col("reply")).alias("g")).select("doc_id", *[F.col(f"g.{c}").cast("long").alias(c) for c in ("relevance", "accuracy", "usefulness")])


@query(f"WITH {S.JUDGED} {S.JUDGE_SUMMARY}")
def judge_summary(spark, d):
    graded = _replies(spark, d).select("quality", context.judgement(F.col("reply")).alias("g")).select("quality", "g.*")
    return context.judge_summary(graded, "quality")


@query("SELECT '| lang | n | mean_chars |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || printf('%.4f', m) || ' |', chr(10) ORDER BY lang) AS markdown FROM (SELECT lang, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY lang)")
def markdown_table(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    return sinks.markdown(rows, "lang")


@query("WITH s AS (SELECT event_type, avg(value) AS mean, max(value) AS most FROM events GROUP BY event_type) SELECT event_type, 'mean' AS measure, round(mean, 6) AS value FROM s UNION ALL SELECT event_type, 'most', round(most, 6) FROM s")
def chart_frame(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return sinks.chart_rows(rows, "event_type", ["mean", "most"]).select("event_type", "measure", *_places(6, "value"))


# Approximate indexes. Hyperplanes come from md5, so SQL can draw them; the other indexes are held against exact search in tests.

_TABLES, _BITS = 12, 5


def _normals():
    return lsh.planes(64, _TABLES, _BITS)


@query(f"WITH {S.lsh(_TABLES, _BITS)} SELECT id, table_id, signature FROM sig")
def lsh_signatures(spark, d):
    return lsh.signatures(_vectors(spark, d), _normals()).select("id", *_long("table_id"), "signature")


@query(f"WITH {S.lsh(_TABLES, _BITS)}, {S.VECTORS}, met AS (SELECT DISTINCT a.id AS q_id, b.id FROM sig a JOIN sig b USING (table_id, signature) WHERE a.id % 20 = 0), s AS (SELECT q_id, id, cosine AS score FROM met JOIN sims USING (q_id, id)) {S.top('s', 10)}")
def lsh_topk(spark, d):
    have, normals = _vectors(spark, d), _normals()
    return lsh.search(_vector_queries(spark, d), have, lsh.signatures(have, normals), normals, 10).select("q_id", "id", *_places(6, "score"), *_long("rank"))


@query()
def ivf_topk(spark, d):
    """All lists scanned by quantised distance, then exact."""
    have = _vectors(spark, d)
    index = ivf.IvfPq.fit(have)
    return index.search(_vector_queries(spark, d), have, index.cells(have), 10, probe=len(index.centres))


@query()
def pq_codes(spark, d):
    have = _vectors(spark, d)
    return ivf.IvfPq.fit(have).cells(have)


@query()
def ivfpq_topk(spark, d):
    have = _vectors(spark, d)
    index = ivf.IvfPq.fit(have)
    return index.search(_vector_queries(spark, d), have, index.cells(have), 10)


@query()
def forest_topk(spark, d):
    have = _vectors(spark, d)
    trees = forest.Forest.fit(have, 40, 60)
    return trees.search(_vector_queries(spark, d), have, trees.leaves(have), 10)


@query()
def graph_topk(spark, d):
    return graph.search(_vector_queries(spark, d), stored(graph.build(_vectors(spark, d))), 10)


@query()
def pca_project(spark, d):
    have = _vectors(spark, d)
    return reduction.Reducer.fit(have, 16).transform(have)
