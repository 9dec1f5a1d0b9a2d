"""Embedding tables, keyed by id and never by position, with a manifest for reuse."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.services import Embedder, ImageEmbedder, embedded, embedded_images
from lodestone.sources.captions import with_images


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def extract(captions: DataFrame, embedder: Embedder, caption_col: str = "caption", key: str = "caption_id", batch: int = 64) -> DataFrame:
    return embedded(captions, embedder, caption_col, key, batch)


def extract_images(captions: DataFrame, found: DataFrame, embedder: ImageEmbedder, image_col: str = "image_path", batch: int = 64) -> DataFrame:
    """image path, embedding, replaced: of every distinct image of the captions, by its file's content among ``found``."""
    return embedded_images(with_images(distinct_images(captions, image_col), found, image_col), embedder, image_col, "content", batch)


def distinct_images(captions: DataFrame, image_col: str = "image_path") -> DataFrame:
    return captions.select(image_col).where(F.col(image_col).isNotNull()).distinct()


def cached(spark: SparkSession, root: str, parameters: dict, make) -> DataFrame:
    """The table made with these parameters, from an earlier run if there is one."""
    path = f"{root}/{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
