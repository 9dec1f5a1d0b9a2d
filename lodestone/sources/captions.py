"""Caption corpora: nested JSON, delimited files, tables with columns under several names, images, and a demo set."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lodestone.config import DEFAULT
from lodestone.functions.text import basename, cleaned, path_of
from lodestone.operators.ranking import group_split, hash_sample
from lodestone.schemas import CAPTION_JSON, DEMO
from lodestone.session import importable


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """image_id, caption, caption_id of every annotation. The schema is stated, so a file without it gives no rows."""
    rows = spark.read.option("multiline", True).schema(CAPTION_JSON).json(path)
    return rows.select(F.explode("annotations").alias("a")).select("a.image_id", "a.caption", F.col("a.id").alias("caption_id"))


def delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A file with a header; all columns are strings."""
    return spark.read.csv(path, sep=separator, header=True)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(frame)


def images(spark: SparkSession, directory: str) -> DataFrame:
    """path, name and content of the image files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(directory)
    return found.select("path", basename(F.col("path")).alias("name"), "content")


def with_images(captions: DataFrame, found: DataFrame, path_col: str = "image_path") -> DataFrame:
    """Adds content and ``missing``: an image that isn't there has null content, for the encoder to replace."""
    name = basename(F.col(path_col))
    joined = captions.withColumn("_name", name).join(found.select(F.col("name").alias("_name"), "content"), "_name", "left")
    return joined.withColumn("missing", F.col("content").isNull()).drop("_name")


def caption_table(spark: SparkSession, path: str, image_dir: str, sample: int | None = None, existing: DataFrame | None = None, seed: int = DEFAULT.seed) -> DataFrame:
    """image_id, image_path, caption of a comma-separated file whose caption column may have one of three names.

    Rows without an image among ``existing`` (name) go; ``sample`` takes so many of the rest by a seeded hash.
    """
    raw = spark.read.csv(path, header=True)
    texts = [F.col(c) for c in ("caption", "comment", "description") if c in raw.columns]
    if not texts:
        raise ValueError("no caption, comment or description column")
    name = basename(F.col("image" if "image" in raw.columns else "image_path"))
    rows = raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("image_id"), F.concat(F.lit(image_dir.rstrip("/") + "/"), name).alias("image_path"), F.coalesce(*texts).alias("caption"), name.alias("_name"))
    if existing is not None:
        rows = rows.join(existing.select(F.col("name").alias("_name")).distinct(), "_name", "left_semi")
    rows = rows.drop("_name")
    return rows if sample is None else hash_sample(rows, "image_path", sample, seed)


def batches(df: DataFrame, size: int = 64) -> DataFrame:
    """One row for each batch of at most so many rows: every column as an array, in order of the rows."""
    importable(df.sparkSession)
    schema = StructType([StructField(f.name, ArrayType(f.dataType)) for f in df.schema.fields])

    def run(found):
        for batch in found:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, part.schema.names)

    return df.mapInArrow(run, schema)


def listed(spark: SparkSession, path: str, key: str, captions: str, form: str = "parquet") -> DataFrame:
    """One row for each item and caption of a table of items that hold lists of captions, in any of Spark's formats."""
    return exploded(spark.read.format(form).load(path), key, captions)


def exploded(rows: DataFrame, key: str, captions: str) -> DataFrame:
    """One row for each item and place of its captions."""
    return rows.select(key, F.posexplode(captions).alias("caption_pos", "caption"))


def clean(captions: DataFrame, caption_col: str = "caption", min_length: int = DEFAULT.min_caption_chars) -> DataFrame:
    """Lower case, kept characters only, and more than ``min_length`` of them."""
    # A filter on a generated column stays above it, so captions are cleaned once.
    out = [F.explode(F.array(cleaned(F.col(c)))).alias(c) if c == caption_col else F.col(c) for c in captions.columns]
    return captions.select(*out).where(F.length(caption_col) > min_length)


def prepare(captions: DataFrame, image_dir: str, path: str, key: str = "image_id", config=DEFAULT) -> dict[str, int]:
    """Cleans, adds paths, splits by image and writes one table by split; returns the rows of each, counted from what was written."""
    rows = group_split(clean(captions).withColumn("image_path", path_of(image_dir, F.col(key))), key, config.validation_share, config.test_share, config.seed)
    rows.write.mode("overwrite").partitionBy("split").parquet(path)
    return {r["split"]: r["n"] for r in captions.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("n")).collect()}


def demo(spark: SparkSession, per_scene: int = 10) -> DataFrame:
    """A made-up set: subjects in three scenes, with years and sources by rule."""
    subjects = {"outdoor": ("a runner", "a red bus", "two dogs", "a market", "a kite"), "indoor": ("a reader", "a laptop", "a sleeping cat", "a guitar", "a lamp"), "nature": ("a heron", "a waterfall", "a pine forest", "a fox", "a storm")}
    places = {"outdoor": ("in the park", "by the street"), "indoor": ("in the kitchen", "near the window"), "nature": ("in the hills", "at the lake")}
    rows = []
    for scene, names in subjects.items():
        for text in [f"{s} {p}" for p in places[scene] for s in names][:per_scene]:
            n = len(rows)
            rows.append((n, f"images/{n:05d}.jpg", text, scene, 2021 + n % 4, ("flickr", "unsplash", "pexels")[n % 3]))
    return spark.createDataFrame(rows, DEMO)


def load(spark: SparkSession, source: str = "demo", **options) -> DataFrame:
    """A corpus by name; a source that can't be read falls back to the demo set only if asked to."""
    fallback = options.pop("fallback", False)
    readers = {"demo": demo, "json": nested_json, "delimited": delimited, "csv": caption_table, "parquet": parquet, "listed": listed}
    if source not in readers:
        raise ValueError(f"unknown source {source!r}; one of {', '.join(readers)}")
    try:
        rows = readers[source](spark, **options)
        rows.limit(1).count()
        return rows
    except Exception:
        if not fallback:
            raise
        return demo(spark)
