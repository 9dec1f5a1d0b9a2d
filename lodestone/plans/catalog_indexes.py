"""Queries on the parts of the approximate indexes: lists, probes, leaves, shards, and what is added later."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import lists_for
from lodestone.operators.ann import forest, graph, kmeans, lsh
from lodestone.operators.ann.index import VectorIndex
from lodestone.plans import catalog as C
from lodestone.plans import sql as S
from lodestone.plans.catalog import _long, _places, query

_LISTS = "(SELECT greatest(10, least(count(*) // 40, 400)) FROM vv)"
_ROUNDS = 3


def _lists(spark, d):
    have = C._vectors(spark, d)
    return have, kmeans.lloyd(have, kmeans.first_centres(have, lists_for(have.count())), _ROUNDS)


@query(f"WITH {S.lists(_LISTS, _ROUNDS)} SELECT id, list, round(far, 6) AS far FROM near")
def kmeans_lists(spark, d):
    """The list of every vector after rounds over the whole table; as many lists as the table's size asks for."""
    return kmeans.assigned(*_lists(spark, d)).select("id", *_long("list"), *_places(6, "far"))


@query(f"WITH {S.lists(_LISTS, _ROUNDS)} SELECT count(*) AS n, count(DISTINCT list) AS n_lists, round(avg(far), 6) AS error FROM near")
def quantisation_error(spark, d):
    return kmeans.assigned(*_lists(spark, d)).agg(F.count("*").alias("n"), F.count_distinct("list").alias("n_lists"), F.round(F.avg("far"), 6).alias("error"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(count(*) - count(*) FILTER (vec_id % 3 > 0) AS BIGINT) AS added FROM embeddings")
def graph_two_batches(spark, d):
    """A graph of two thirds of the vectors, to which the others are added, counted after their insertion."""
    have = C._vectors(spark, d)
    index = VectorIndex.build(have.where("id % 3 > 0"), "graph", beam=40)
    before = index.manifest["n"]
    nodes = index.add(have, beam=40).compact(beam=40).tables["nodes"]
    return nodes.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum("id").alias("ids"), (F.count("*") - F.lit(before)).alias("added"))


@query()
def graph_routed_topk(spark, d):
    """Of shards of some 50 vectors, a query visits the eight nearest."""
    nodes = C.stored(graph.build(C._vectors(spark, d), beam=40, shard=50))
    return graph.search(C._vector_queries(spark, d), nodes, 10)


_FLIPS = 4


def _probing(spark, d):
    """Signatures four bits longer than those of ``lsh_topk``, and as many probes of each table."""
    have, normals = C._vectors(spark, d), lsh.planes(64, C._TABLES, C._BITS + 4)
    return have, normals, lsh.signatures(have, normals)


@query(f"WITH {S.probed(C._TABLES, C._BITS + 4, _FLIPS)} SELECT q_id, count(*) AS n_candidates FROM met GROUP BY q_id")
def lsh_probe_candidates(spark, d):
    _, normals, buckets = _probing(spark, d)
    return lsh.candidates(C._vector_queries(spark, d), buckets, normals, _FLIPS).groupBy("q_id").agg(F.count("*").alias("n_candidates"))


@query(f"WITH {S.probed(C._TABLES, C._BITS + 4, _FLIPS)}, {S.VECTORS}, s AS (SELECT q_id, id, cosine AS score FROM met JOIN sims USING (q_id, id)) {S.top('s', 10)}")
def lsh_probe_topk(spark, d):
    have, normals, buckets = _probing(spark, d)
    return lsh.search(C._vector_queries(spark, d), have, buckets, normals, 10, flips=_FLIPS).select("q_id", "id", *_places(6, "score"), *_long("rank"))


@query("SELECT count(*) * 4 AS n_rows, count(*) AS n_ids, true AS bounded FROM embeddings")
def forest_leaf_sizes(spark, d):
    """Trees whose tops are grown for leaves of half the table, split until no leaf has more than 20: every vector once in each tree."""
    have = C._vectors(spark, d)
    _, leaves = forest.Forest.fit(have, 4, max(2, have.count() // 2)).split(have, 20)
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    facts = leaves.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    return facts.crossJoin(sizes.agg((F.max("n") <= 20).alias("bounded")))
