"""Queries that write what they read: each source and sink over whole tables, through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import bm25, ranking
from lodestone.plans import catalog as C
from lodestone.plans import sql as S
from lodestone.plans.catalog import query
from lodestone.session import shared_folder, table
from lodestone.sources import captions, embeddings, sinks


@query("SELECT conv_id AS image_id, text AS caption, conv_id * 1000 + turn AS caption_id FROM conversations")
def nested_json_scan(spark, d):
    """Eight files, each one object with a list of annotations."""
    path = f"{shared_folder(spark)}/captions"
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), F.col("text").alias("caption"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    files = rows.groupBy(F.pmod("image_id", F.lit(8)).alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct("image_id", "caption", "id")).alias("annotations"))).alias("value"))
    files.write.partitionBy("file").text(path)
    return captions.nested_json(spark, f"{path}/*")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, url FROM pages")
def tab_scan(spark, d):
    path = f"{shared_folder(spark)}/pages"
    table(spark, d, "pages").select("page_id", "url").write.csv(path, sep="\t", header=True)
    return captions.delimited(spark, path)


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def pipe_scan(spark, d):
    path = f"{shared_folder(spark)}/events"
    table(spark, d, "events").select("event_id", "event_type", "user_id").write.csv(path, sep="|", header=True)
    return captions.delimited(spark, path, "|")


_CSV = "SELECT CAST(doc_id AS VARCHAR) AS image_id, 'pics/' || doc_id || '.jpg' AS image_path, lang || ' ' || source AS caption FROM documents"


def _csv(spark, d) -> str:
    path = f"{shared_folder(spark)}/documents"
    name = F.concat(F.lit("somewhere/"), F.col("doc_id"), F.lit(".jpg"))
    table(spark, d, "documents").select(name.alias("image"), F.concat_ws(" ", "lang", "source").alias("comment")).write.csv(path, header=True)
    return path


@query(_CSV)
def csv_captions(spark, d):
    return captions.caption_table(spark, _csv(spark, d), "pics")


@query(f"{_CSV} WHERE doc_id IN (SELECT doc_id FROM labels)")
def csv_captions_existing(spark, d):
    """Only rows whose picture is there: labelled documents have one."""
    have = table(spark, d, "labels").select(F.concat("doc_id", F.lit(".jpg")).alias("name"))
    return captions.caption_table(spark, _csv(spark, d), "pics/", existing=have)


@query(f"SELECT * FROM ({_CSV}) ORDER BY md5(image_path || ':42'), image_path LIMIT 100")
def csv_captions_sampled(spark, d):
    return captions.caption_table(spark, _csv(spark, d), "pics", sample=100)


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS caption_pos, text AS caption FROM conversations")
def listed_captions(spark, d):
    """A table of items with lists of captions, one row for each caption."""
    path = f"{shared_folder(spark)}/items"
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda r: r["text"]).alias("texts")).write.parquet(path)
    return captions.listed(spark, path, "conv_id", "texts").select("conv_id", F.col("caption_pos").cast("long").alias("caption_pos"), "caption")


@query("SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS missing FROM documents")
def image_fallback(spark, d):
    """Pictures that aren't there are flagged for the encoder; labelled documents have one."""
    have = table(spark, d, "labels").select(F.concat("doc_id", F.lit(".jpg")).alias("name"), F.lit(b"x").alias("content"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("pics/"), F.col("doc_id"), F.lit(".jpg")).alias("image_path"))
    return captions.with_images(rows, have).select("doc_id", "missing")


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, true AS bounded FROM documents")
def batch_collate(spark, d):
    """Batches of at most 64 rows hold every row once."""
    found = captions.batches(table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), "lang"), 64)
    n = found.select(F.size("doc_id").alias("n"), F.explode("doc_id").alias("doc_id"), (F.size("caption") == F.size("lang")).alias("even"))
    return n.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"), (F.bool_and("even") & (F.max("n") <= 64)).alias("bounded"))


@query(f"SELECT vec_id, pos, round(x, 6) AS x FROM (SELECT vec_id, unnest({S.V}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def embeddings_reloaded(spark, d):
    path = f"{shared_folder(spark)}/vectors"
    embeddings.save(table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    rows = embeddings.load(spark, path).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("SELECT count(*) AS n_rows, 1::BIGINT AS n_made FROM embeddings")
def embeddings_cached(spark, d):
    """Asked for twice, made once."""
    root, made = shared_folder(spark), []

    def make():
        made.append(1)
        return table(spark, d, "embeddings")

    for _ in range(2):
        rows = embeddings.cached(spark, root, {"model": "hashing", "batch": 64}, make)
    return rows.agg(F.count("*").alias("n_rows"), F.lit(len(made)).cast("long").alias("n_made"))


@query("SELECT vec_id, len(embedding) AS width FROM embeddings")
def width_checked(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(V.checked(F.col("embedding"), 64)).cast("long").alias("width"))


_DEMO_TERMS = S.terms_of(f"(SELECT image_id AS q_id, caption AS text FROM ({S.DEMO}))")


@query(f"WITH {S.INDEX}, {_DEMO_TERMS}, {S.BM25}, best AS ({S.top('bm', 3)}) SELECT image_id, image_path, caption, scene, year, source, id, score, rank FROM ({S.DEMO}) LEFT JOIN best ON q_id = image_id")
def demo_set(spark, d):
    """The demo set, each caption with the documents that it finds by its words."""
    items = captions.demo(spark).select(F.col("image_id").cast("long").alias("image_id"), "image_path", "caption", "scene", F.col("year").cast("long").alias("year"), "source")
    found = bm25.topk(C._index(spark, d), items.select(F.col("image_id").alias("q_id"), F.col("caption").alias("text")), 3)
    return items.join(found.select(F.col("q_id").alias("image_id"), "id", *C._places(6, "score"), *C._long("rank")), "image_id", "left")


@query(f"WITH {S.INDEX}, {_DEMO_TERMS}, {S.BM25} SELECT scene, count(DISTINCT image_id) AS n, count(DISTINCT id) AS n_documents FROM ({S.DEMO}) LEFT JOIN bm ON q_id = image_id GROUP BY scene")
def source_fallback(spark, d):
    """A source that can't be read gives the demo set where that is asked for; of each scene, the documents that share words with it."""
    rows = captions.load(spark, "csv", path=f"{shared_folder(spark)}/nothing", image_dir="pics", fallback=True)
    met = bm25.scores(C._index(spark, d), rows.select(F.col("image_id").cast("long").alias("q_id"), F.col("caption").alias("text")))
    joined = rows.join(met.select(F.col("q_id").alias("image_id"), "id"), "image_id", "left")
    return joined.groupBy("scene").agg(F.count_distinct("image_id").alias("n"), F.count_distinct("id").alias("n_documents"))


_LABELS = "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels"


def _labels(df):
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "quality", "toxic")])


@query(_LABELS)
def pandas_rows(spark, d):
    """A frame of the driver as rows; labels stand for a small one."""
    return _labels(captions.from_pandas(spark, table(spark, d, "labels").toPandas()))


@query(_LABELS)
def parquet_sink(spark, d):
    path = f"{shared_folder(spark)}/labels"
    sinks.to_parquet(table(spark, d, "labels"), path)
    return _labels(captions.parquet(spark, path))


@query(_LABELS)
def csv_sink(spark, d):
    path = f"{shared_folder(spark)}/labels"
    sinks.to_csv(table(spark, d, "labels"), path)
    return _labels(spark.read.csv(path, header=True))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def json_sink(spark, d):
    path = f"{shared_folder(spark)}/summary"
    sinks.to_json(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("lang string, n bigint, chars bigint").json(path)


@query("SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels")
def numpy_columns(spark, d):
    quality, toxic = sinks.to_numpy(table(spark, d, "labels"), ["quality", "toxic"])
    return spark.createDataFrame([(len(quality), int(quality.sum()), int(toxic.sum()))], "n bigint, quality bigint, toxic bigint")


@query(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN s < 0.1 THEN 'test' WHEN s < 0.1 + 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT {S.share('doc_id')} AS s FROM ({S.CLEAN}))) GROUP BY split")
def prepared_splits(spark, d):
    """Captions cleaned, given paths, split by item and written; the rows of each split are counted from what was written."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("caption"))
    found = captions.prepare(rows, "images", f"{shared_folder(spark)}/prepared")
    return spark.createDataFrame(sorted(found.items()), "split string, n bigint")


@query("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM embeddings")
def positional_split(spark, d):
    return ranking.positional_split(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@query("SELECT DISTINCT url FROM pages WHERE url IS NOT NULL")
def distinct_images(spark, d):
    return embeddings.distinct_images(table(spark, d, "pages"), "url")
