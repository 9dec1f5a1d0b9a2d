"""BM25 over an inverted index kept as tables: postings, documents, terms, and one row of corpus figures.

Stored postings and terms lie in buckets by a hash of the term, one folder each, sorted by term within. A search reads the
buckets of the asked terms only, and where few terms are asked, only the row groups that may hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.functions.text import tokens
from lodestone.operators.ranking import top
from lodestone.session import SMALL, stored

#: Words of a bucket and of a task that writes one, about; most buckets.
BUCKET_WORDS, TASK_WORDS, BUCKETS = 250_000, 4_000_000, 4096
#: Words whose documents are counted together before they are exchanged, about, and rows that are yielded at once.
PIECE_WORDS, ROWS = 2_000_000, 10_000
#: Asked terms up to which they are looked for in the row groups of their buckets.
FEW_TERMS = 200


def layout(words: int) -> tuple[int, int]:
    """Buckets, and the parts that each is dealt to by document when it is written, so that one very frequent term is many tasks' work."""
    buckets = min(BUCKETS, max(16, 1 << (words // BUCKET_WORDS).bit_length()))
    return buckets, max(1, -(-words // (buckets * TASK_WORDS)))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Bm25Index:
    postings: DataFrame  # term, doc_id, tf, dl; bucket where they are stored
    docs: DataFrame  # doc_id, dl
    terms: DataFrame  # term, df, idf; bucket where they are stored
    stats: DataFrame  # n, avgdl; buckets where they are stored
    words: DataFrame | None = None  # doc_id, dl and words of every document, where the index is not stored yet
    buckets: int | None = None  # where it is stored

    def save(self, path: str) -> None:
        """One exchange by bucket and part both brings equal words together and lays the postings out; terms are counted from what was written.

        Words are counted by document before it, and a term's documents of some PIECE_WORDS words are one row of it.
        """
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        buckets, parts = layout(docs.agg(F.sum("dl")).first()[0] or 0)
        place = ["bucket", "part"]
        rows = (self.postings if self.words is None else self.words).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
        if self.words is not None:
            rows = counted(rows)
        laid = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(buckets * parts, *place)
        if self.words is not None:
            laid = laid.select(*place, "term", F.inline(F.arrays_zip("doc_id", "dl", "tf")))
        laid = laid.groupBy(*place, "term", "doc_id", F.col("dl").cast("long").alias("dl")).agg(F.sum("tf").alias("tf")).select("term", "doc_id", "tf", "dl", "bucket")
        laid.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        schema = laid.schema
        again = of_tables(spark.read.schema(schema).parquet(f"{path}/postings"), docs)
        again.terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        again.stats.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        kind = spark.read.parquet(f"{path}/docs").schema["doc_id"].dataType.simpleString()
        schemas = {"postings": f"term string, doc_id {kind}, tf bigint, dl bigint, bucket int", "terms": "term string, df bigint, idf double, bucket int"}
        read = lambda name: (spark.read.schema(schemas[name]) if name in schemas else spark.read).parquet(f"{path}/{name}")
        tables = dict(zip(("postings", "docs", "terms", "stats"), map(read, ("postings", "docs", "terms", "stats")), strict=True))
        return cls(**tables, buckets=tables["stats"].first()["buckets"])

    def asked(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Postings and terms as far as the asked terms (term) may be in them, and whether those are few enough to be sent everywhere.

        What is looked at on the driver is bounded: the numbers of buckets, and few terms.
        """
        if self.buckets is None:
            return self.postings, self.terms, asked.limit(SMALL + 1).count() <= SMALL
        n, found = asked.agg(F.count("*"), F.collect_set(bucket_of(F.col("term"), self.buckets))).first()
        where = F.lit(True) if len(found) == self.buckets else F.col("bucket").isin(sorted(found)) if found else F.lit(False)
        if 0 < n <= FEW_TERMS:
            where &= F.col("term").isin(sorted(r["term"] for r in asked.select("term").distinct().collect()))
        return self.postings.where(where), self.terms.where(where), n <= SMALL


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def build(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Bm25Index:
    """Documents without words count in n and avgdl with length 0. Postings carry the length of their document."""
    words = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("words"))
    docs = words.select("doc_id", F.size("words").cast("long").alias("dl"))
    # explode would put a filter on the words below them, which would split texts twice.
    each = words.select("doc_id", F.size("words").cast("long").alias("dl"), F.explode_outer("words").alias("term")).where(F.col("term").isNotNull())
    index = of_tables(each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "dl"), docs)
    index.words = words.select("doc_id", F.size("words").alias("dl"), "words")
    return index


def counted(words: DataFrame) -> DataFrame:
    """part, term, and the doc_id, dl and tf of some of the documents (doc_id, dl, words, part) that have it, each list as long."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends, at = np.cumsum(batch["dl"].to_numpy()), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_WORDS, "right")))
            yield batch.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                each = pa.table({"row": pc.list_parent_indices(piece["words"]), "term": pc.list_flatten(piece["words"])})
                tf = each.group_by(["row", "term"]).aggregate([([], "count_all")])
                own = {c: piece[c].take(tf["row"].combine_chunks()) for c in ("part", "doc_id", "dl")}
                lists = pa.table({**own, "term": tf["term"], "tf": tf["count_all"].cast(pa.int32())}).group_by(["part", "term"]).aggregate([(c, "list") for c in ("doc_id", "dl", "tf")])
                yield from lists.select(["part", "term", "doc_id_list", "dl_list", "tf_list"]).rename_columns(["part", "term", "doc_id", "dl", "tf"]).combine_chunks().to_batches(ROWS)

    return words.select("doc_id", "dl", "words", "part").mapInArrow(run, f"part int, term string, doc_id array<{kind}>, dl array<int>, tf array<int>")


def of_tables(postings: DataFrame, docs: DataFrame) -> Bm25Index:
    """Terms keep the bucket of their postings, if they lie in buckets."""
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    by = [c for c in ("bucket",) if c in postings.columns]
    terms = postings.groupBy("term", *by).agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"), *by)
    return Bm25Index(postings, docs, terms, stats)


def query_terms(queries: DataFrame, id_col: str = "q_id", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(id_col).alias("q_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("q_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Bm25Index, queries: DataFrame, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """q_id, id, score > 0. A query's repeated terms count as often; only its own terms' postings are read.

    What is exchanged is each posting of an asked term once, by document; a document then meets the queries and adds its
    scores up where it is, as hits of queries by terms are many times the postings.
    """
    asked = query_terms(queries)
    postings, terms, few = index.asked(asked)
    # Queries of a bounded number of terms go to the index, not the index to them; a term has one row there.
    sent = F.broadcast if few else lambda df: df
    own = postings.join(sent(asked.select("term").distinct()), "term", "left_semi").select("doc_id", "term", "tf", "dl")
    if few:
        own = own.repartition("doc_id")
    hits = own.join(sent(terms.select("term", "idf").join(sent(asked), "term")), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("q_id", "doc_id").agg(F.sum(part).alias("score")).withColumnRenamed("doc_id", "id")


def topk(index: Bm25Index, queries: DataFrame, k: int, fill_zero: bool = False, **parameters) -> DataFrame:
    """q_id, id, score, rank. ``fill_zero`` adds documents with score 0, by id, to queries with fewer than k hits."""
    found = top(scores(index, queries, **parameters), k)
    if not fill_zero:
        return found
    found = stored(found)  # read twice
    # The k documents of least id suffice: at most k of them can be wanted beside the hits and k others.
    spare = index.docs.orderBy("doc_id").limit(2 * k).select(F.col("doc_id").alias("id"))
    zeros = queries.select("q_id").distinct().crossJoin(F.broadcast(spare)).join(found.select("q_id", "id"), ["q_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(found.select("q_id", "id", "score").unionByName(zeros), k)
