"""Queries on stored indexes, the experiment drivers, prompts, judgements and requests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.config import lists_for, trees_for
from lodestone.functions import text as T
from lodestone.operators import bm25, context, dense, metrics, services
from lodestone.operators.ann.index import VectorIndex, self_recall, timed_comparison
from lodestone.operators.retrieve import Retriever, captions_of_matches
from lodestone.plans import catalog as C
from lodestone.plans import experiments, requests
from lodestone.plans import sql as S
from lodestone.plans.catalog import _long, _places, query
from lodestone.session import shared_folder, table


# Sparse search whose rows are filled up, alone and as one side of a fusion.


@query(S.FILLED)
def bm25_topk_filled(spark, d):
    return bm25.topk(C._index(spark, d), C._repeats(spark), 10, fill_zero=True).select("q_id", "id", *_places(6, "score"), *_long("rank"))


@query(S.HYBRID_FILLED)
def hybrid_fixed_filled(spark, d):
    found = Retriever(C._vectors(spark, d), C._index(spark, d), fill_zero=True).search(C._hybrid_queries(spark, d), 10, "fixed_weight")
    return found.select("q_id", "id", *_places(6, "score"), *_long("rank"))


# Indexes that were written and read again.


def _found(rows):
    return rows.select("q_id", "id", *_places(6, "score"), *_long("rank"))


@query(f"WITH {S.VECTORS}, s AS (SELECT q_id, id, cosine AS score FROM sims) {S.top('s', 10)}")
def flat_index_topk(spark, d):
    return _found(VectorIndex.build(C._vectors(spark, d), "flat").search(C._vector_queries(spark, d), 10))


@query(C.oracle_of("lsh_topk"))
def lsh_index_topk(spark, d):
    return _found(VectorIndex.build(C._vectors(spark, d), "lsh", tables=C._TABLES, bits=C._BITS).search(C._vector_queries(spark, d), 10))


@query()
def index_recall(spark, d):
    """What share of the exact ten nearest each index, read again, finds; no SQL can tell, so tests hold it at 0.9."""
    have, asked = C._vectors(spark, d), C._vector_queries(spark, d)
    exact = dense.exact_topk(asked, have, 10)
    found = [(kind, round(float(self_recall(VectorIndex.build(have, kind, **p), asked, exact)), 6)) for kind, p in (("ivfpq", {}), ("forest", {"trees": 40, "leaf": 60}), ("graph", {}))]
    return spark.createDataFrame(found, "kind string, recall double")


@query("SELECT count(*) AS n, round(count(*) * 64 * 4 / 1048576.0::DOUBLE, 6) AS mb FROM embeddings")
def memory_estimate(spark, d):
    n = C._vectors(spark, d).count()
    return spark.createDataFrame([(n, round(dense.memory_mb(n, 64), 6))], "n bigint, mb double")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, greatest(10, least(count(*) // 40, 400)) AS lists, least(50, count(*) // 20 + 10) AS trees FROM {t}" for t in ("documents", "embeddings", "pages")))
def index_sizes(spark, d):
    counts = [(t, table(spark, d, t).count()) for t in ("documents", "embeddings", "pages")]
    return spark.createDataFrame([(t, n, lists_for(n), trees_for(n)) for t, n in counts], "name string, n bigint, lists bigint, trees bigint")


# Experiments. Their seconds are left out here, as no two runs share them.


def _summary(rows, *names: str):
    return rows.select(*names, "n_queries", *_places(6, "recall_1", "recall_10", "mrr"))


@query(S.COMPARISON)
def e1_exact_and_lsh(spark, d):
    found = timed_comparison(C._vectors(spark, d), C._vector_queries(spark, d), {"flat": {}, "lsh": {"tables": 16, "bits": 6}})
    gold = C._classes(spark, d)
    rows = [metrics.summary(got, gold).withColumn("index", F.lit("exact" if kind == "flat" else kind)) for kind, (got, _, _) in found.items()]
    return _summary(rows[0].unionByName(rows[1]), "index")


@query()
def e1_comparison(spark, d):
    return _summary(experiments.ann_comparison(C._vector_queries(spark, d), C._vectors(spark, d), C._classes(spark, d)), "index")


@query()
def e2_reduction(spark, d):
    return _summary(experiments.reduction_comparison(C._vector_queries(spark, d), C._vectors(spark, d), C._label_gold(spark, d), (8, 16, 32), methods=("pca", "umap", "tsne")), "method", "dim", "explained", *_places(3, "fit_s", "search_s"))


@query(S.DIRECTIONS)
def e4_directions(spark, d):
    """Vectors of even id stand for texts, those of odd id for images; those of one label belong together."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    texts, images = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    pairs = texts.select(F.col("id").alias("text_id"), "label").join(images.select(F.col("id").alias("image_id"), "label"), "label")
    return _summary(experiments.both_directions(texts.drop("label"), images.drop("label"), pairs), "direction")


@query()
def e6_scale(spark, d):
    kinds = {"ivfpq": {}, "graph": {}, "forest": {"trees": 20}}
    have = C._vectors(spark, d)
    found = experiments.scale(C._vector_queries(spark, d), have, C._label_gold(spark, d), experiments.sizes_of(have, (250, 500)), 10, kinds)
    return _summary(found, *_long("size"), "index", *_places(3, "build_s", "search_s", "qps"))


@query("SELECT item_id AS q_id, 'ok' AS status, 'Best match: [' || length(text) || ']' AS answer FROM benchmark")
def answers_kept(spark, d):
    """Asked twice, once with a generator that fails whatever it is asked: replies that are kept aren't asked for again."""
    path = shared_folder(spark)
    prompts = C._asked(spark, d).select("q_id", F.concat(F.lit("["), F.length("text").cast("string"), F.lit("]")).alias("prompt"))
    services.answered_once(prompts, services.TemplateGenerator(), path).count()
    return services.answered_once(prompts, Failing(), path)


class Failing:
    """A generator whose endpoint is gone."""

    def generate(self, prompts: list[str]) -> list[tuple[str, str]]:
        return [("error", "gone")] * len(prompts)


@query("SELECT event_type, count(value) AS n, round(count(value) / (sum(value) / 1000), 6) AS qps FROM events GROUP BY event_type")
def throughput(spark, d):
    """Of calls one after the other, from their milliseconds."""
    return metrics.throughput_by(table(spark, d, "events"), "value", "event_type").select("event_type", "n", *_places(6, "qps"))


# Prompts and what comes back.


def _told(spark, d):
    return C._asked(spark, d).join(context.context(C._results(spark, d), C._captions(spark, d)), "q_id")


def _prompt(template: str, **values: str) -> str:
    return f"WITH {S.CONTEXT} SELECT q_id, {S.filled(template, **values)} AS prompt FROM ctx JOIN (SELECT item_id AS q_id, text FROM benchmark) USING (q_id)"


@query(_prompt(context.COMPARISON, query="text", context_a="context", context_b=S.quoted(context.EMPTY), strategy_a="'bm25'", strategy_b="'nothing'"))
def comparison_prompt(spark, d):
    return _told(spark, d).select("q_id", context.comparison_prompt(F.col("text"), F.col("context"), F.lit(context.EMPTY), "bm25", "nothing").alias("prompt"))


@query(_prompt(context.IMAGE, context="context"))
def image_prompt(spark, d):
    return _told(spark, d).select("q_id", context.image_prompt(F.col("context")).alias("prompt"))


@query(f"SELECT item_id AS q_id, {S.filled(context.TRANSLATE, query='text')} AS prompt FROM benchmark")
def translate_prompt(spark, d):
    return C._asked(spark, d).select("q_id", context.translate_prompt(F.col("text")).alias("prompt"))


@query(_prompt(context.JUDGE, query="text", context="context", answer="substr(context, 1, 1000)"))
def judge_prompt(spark, d):
    return _told(spark, d).select("q_id", context.judge_prompt(F.col("text"), F.col("context"), F.col("context")).alias("prompt"))


@query(f"WITH {S.CONTEXT}, three AS (SELECT q_id, rank, '[' || rank || '] score=' || printf('%.4f', score) || ' | ' || substr(coalesce(text, ''), 1, 200) AS line FROM hits LEFT JOIN documents ON doc_id = id WHERE rank <= 3) SELECT q_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM three GROUP BY q_id")
def judge_context(spark, d):
    return context.judge_context(C._results(spark, d).join(C._captions(spark, d), "id", "left"))


@query(f"WITH {S.CONTEXT}, own AS (SELECT q_id, string_agg('[' || rank || '] (Score: ' || printf('%.3f', score) || ') ' || coalesce(text, ''), chr(10) ORDER BY rank) AS context FROM hits LEFT JOIN documents ON doc_id = id GROUP BY q_id) SELECT * FROM own")
def context_of_own_captions(spark, d):
    """From the caption that each result carries itself."""
    return context.context(C._results(spark, d).join(C._captions(spark, d), "id", "left"), label=" ")


@query(f"WITH {S.CONTEXT}, ten AS (SELECT * FROM ({S.ranked('bm')}) WHERE rank <= 10) SELECT q_id, id, rank FROM ten WHERE id IN (SELECT doc_id FROM labels)")
def known_ids(spark, d):
    """Results that are no item go; labelled documents are the items."""
    items = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return requests.known(C._results(spark, d), items).select("q_id", "id", *_long("rank"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def label_strip(spark, d):
    """A label before a translation goes, whichever it is."""
    label = F.element_at(F.array(F.lit("English translation: "), F.lit("Translation:"), F.lit("english:  ")), (F.col("doc_id") % 3 + 1).cast("int"))
    plain = F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " "))
    return table(spark, d, "documents").select("doc_id", T.without_label(F.concat(F.lit(" "), label, plain)).alias("text"))


class Counting:
    """A translator and judge that tells what it was given."""

    def translate(self, texts: list[str]) -> list[str]:
        return [f"Translation: a query of {len(t)} characters" for t in texts]

    def grade(self, prompts: list[str]) -> list[str]:
        return ["```json\n" + json.dumps({"relevance": 1 + len(p) % 5, "accuracy": 1 + (len(p) + 1) % 5, "usefulness": 1 + (len(p) + 2) % 5}) + "\n```" for p in prompts]


@query("SELECT doc_id AS q_id, CASE WHEN doc_id % 3 = 0 OR regexp_matches(text, '[一-鿿]') THEN 'a query of ' || (length(text) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END) || ' characters' ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def translated_queries(spark, d):
    """Documents as questions; two characters behind a third of them make those Chinese."""
    asked = C._documents(spark, d).where(F.col("text").isNotNull()).select(F.col("doc_id").alias("q_id"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 照片"))).otherwise(F.col("text")).alias("text"))
    return services.translated(asked, Counting()).select("q_id", "text")


@query("SELECT doc_id AS q_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 1 + length('p' || doc_id) % 5 END AS relevance, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 1 + (length('p' || doc_id) + 1) % 5 END AS accuracy, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 1 + (length('p' || doc_id) + 2) % 5 END AS usefulness FROM labels")
def graded_answers(spark, d):
    """An empty answer is graded 1 unasked, the others by the judge."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("q_id"), F.concat(F.lit("p"), "doc_id").alias("prompt"), F.when(F.col("doc_id") % 5 != 0, "an answer").alias("answer"))
    return services.graded(rows, Counting()).select("q_id", *_long("relevance", "accuracy", "usefulness"))


# Requests.


@query(S.ANSWERS)
def e5_answers(spark, d):
    found = experiments.answers(C._retriever(spark, d), C._hybrid_queries(spark, d), C._captions(spark, d), services.TemplateGenerator())
    return found.select("q_id", "status", "answer")


@query(f"WITH {S.VECTORS}, s AS (SELECT q_id, id, cosine AS score FROM sims), best AS ({S.top('s', 10)}), few AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS captions FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id) SELECT q_id, id, rank, captions FROM best LEFT JOIN few ON conv_id = id")
def captions_of_similar(spark, d):
    texts = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("caption"))
    found = captions_of_matches(C._vector_queries(spark, d), C._vectors(spark, d), texts)
    return found.select("q_id", "id", *_long("rank"), F.array_join("captions", "|").alias("captions"))


@query()
def text_requests(spark, d):
    """Questions put into English, encoded whole by feature hashing, searched, told and answered."""
    items, encoder = C._captions(spark, d), services.HashingEmbedder(max_tokens=None)
    vectors = services.embedded(items, encoder, "caption", "id")
    found = requests.of_texts(Retriever(vectors, C._index(spark, d)), C._spoken(spark), items, encoder, services.TemplateGenerator(), translator=Counting())
    return found.select("q_id", F.size("results").alias("n_results"), "context", "status", "answer")


@query()
def image_requests(spark, d):
    """Pages stand for pictures: their bytes are encoded, and conversations for captions."""
    pictures = table(spark, d, "pages").select(F.col("page_id").alias("q_id"), F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), F.col("html").cast("binary")).alias("content"))
    vectors = services.embedded_images(pictures, services.HashingImageEmbedder(), "q_id").select(F.col("q_id").alias("id"), "embedding")
    texts = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("caption"))
    found = requests.of_images(pictures, vectors, texts, services.HashingImageEmbedder(), services.TemplateGenerator())
    return found.select("q_id", F.size("results").alias("n_results"), "context", "status", "answer")
