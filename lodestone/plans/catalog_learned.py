"""Queries on what is learnt from the tables: words by their company, and maps of neighbours."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import learned, neighbours, services
from lodestone.operators import reduce as reduction
from lodestone.plans import catalog as C
from lodestone.plans import experiments
from lodestone.plans import sql as S
from lodestone.plans.catalog import _long, _places, query


def _texts(spark, d):
    return C._documents(spark, d).select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {S.vocabulary(learned.VOCABULARY, learned.LEAST)} SELECT term, n FROM voc")
def word_vocabulary(spark, d):
    return learned.vocabulary(_texts(spark, d)).select("term", *_long("n"))


@query(f"""WITH {S.company(learned.VOCABULARY, learned.LEAST, learned.WINDOW)}
SELECT a AS term, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_beside, round(sum(value), 6) AS value FROM cell GROUP BY a""")
def word_company(spark, d):
    """Of every word: the pairs that it is in, with how many words, and the sum of its positive cells."""
    words = [r["term"] for r in learned.vocabulary(_texts(spark, d)).collect()]
    counted = C.stored(learned.pairs(_texts(spark, d), words))
    names = spark.createDataFrame(list(enumerate(words)), "row bigint, term string")
    values = learned.cells(counted).groupBy("row").agg(F.sum("value").alias("value"))
    sums = counted.groupBy("row").agg(F.sum("n").alias("n"), F.count("*").alias("n_beside")).join(values, "row", "left")
    return sums.join(F.broadcast(names), "row").select("term", *_long("n", "n_beside"), *_places(6, "value"))


@query()
def encoder_recall(spark, d):
    """Documents that hold a benchmark text as it is, searched by hashing, by hashing with learnt weights, and by learnt vectors."""
    texts, asked = _texts(spark, d), C._asked(spark, d)
    gold = C.stored(experiments.verbatim_gold(texts, asked))
    encoders = {"hashing": services.HashingEmbedder(max_tokens=None), "weighted": learned.CorpusEmbedder.fit(texts, company=False), "learnt": learned.CorpusEmbedder.fit(texts)}
    return experiments.encoder_comparison(texts, asked, gold, encoders).select("encoder", "n_queries", *_places(6, "recall_1", "recall_10", "mrr"))


# Maps of neighbours.

_BESIDE = 10


@query(f"""WITH {S.trusted(_BESIDE)} SELECT q_id, CAST(sum(greatest(rank - {_BESIDE}, 0)) AS BIGINT) AS penalty FROM ranked GROUP BY q_id""")
def map_penalties(spark, d):
    """The first two components as a map, which anyone can draw: by how many ranks its neighbours are too far off."""
    have = C._vectors(spark, d)
    return neighbours.trust(have, have.select("id", F.slice("embedding", 1, 2).cast("array<double>").alias("embedding")), C._vector_queries(spark, d).select("q_id"), _BESIDE)


@query()
def neighbour_graph(spark, d):
    return neighbours.graph(C._vectors(spark, d), _BESIDE)


@query()
def map_trust(spark, d):
    """Trust in maps of two dimensions: the first components, principal components, neighbours of a sample, and of all vectors."""
    have = C.stored(C._vectors(spark, d).select("id", "embedding"))
    asked = C._vector_queries(spark, d).select("q_id")
    maps = {
        "components": have.select("id", F.slice("embedding", 1, 2).alias("embedding")),
        **{m: reduction.fitted(have, 2, m).transform(have) for m in reduction.METHODS},
        "drawn": neighbours.drawn_map(have),
    }
    rows = [neighbours.trustworthiness(have, places.select("id", F.col("embedding").cast("array<double>").alias("embedding")), asked, _BESIDE).select(F.lit(m).alias("map"), "n_queries", *_places(6, "trust")) for m, places in maps.items()]
    return functools.reduce(DataFrame.unionByName, rows)
