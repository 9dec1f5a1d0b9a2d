"""Pictures as pixels: decoded by Spark's image source, and described by where they are light and by their colours.

Two files of one picture, in other formats, sizes or qualities, have nearly the same pixels at the scale of a coarse grid,
and so nearly the same vector, though no byte of the files is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import importable

#: Cells a side of the grid of lightness, and of the one of colours.
GRID, COLOURS = 8, 2
#: Numbers of a picture's vector: lightness of the cells; mean and deviation of three channels in each of the larger ones.
WIDTH = GRID * GRID + COLOURS * COLOURS * 6
#: Weights of blue, green and red in lightness (fixed values).
LIGHT = np.array([0.114, 0.587, 0.299])


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, data of every file below ``path``: pixels by rows, blue first. Files that are no picture have null data."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    fine = F.col("height") > 0
    return image.select(F.col("origin").alias("path"), *[F.when(fine, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def _cells(pixels: np.ndarray, n: int) -> list[np.ndarray]:
    """The pixels of each cell of a grid, row by row; pictures of fewer pixels a side than cells repeat theirs."""
    for axis in (0, 1):
        pixels = np.repeat(pixels, -(-n // pixels.shape[axis]), axis=axis)
    return [c for row in np.array_split(pixels, n, axis=0) for c in np.array_split(row, n, axis=1)]


def described(pixels: np.ndarray) -> np.ndarray:
    """A vector of unit length from (height, width, 1, 3 or 4) values up to 255; the zero vector for a picture of black."""
    pixels = pixels[:, :, :3] / 255.0 if pixels.shape[2] >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2) / 255.0
    light = np.array([(c @ LIGHT).mean() for c in _cells(pixels, GRID)])
    colours = [f for c in _cells(pixels, COLOURS) for f in (*c.mean((0, 1)), *c.std((0, 1)))]
    vector = np.concatenate([light - light.mean(), np.array(colours) / COLOURS])
    return vector / (np.linalg.norm(vector) + 1e-10)


def picture_vectors(rows: DataFrame) -> DataFrame:
    """path, embedding of pictures; those without pixels count as black ones, and so have the zero vector."""
    importable(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch[n].to_pylist() for n in ("height", "width", "channels")), batch["data"], strict=True):
                blank = not data.is_valid or not h or not w
                out.append(np.zeros(WIDTH) if blank else described(np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, c)))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([x.astype(np.float32).tolist() for x in out], pa.list_(pa.float32()))], ["path", "embedding"])

    return rows.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, embedding array<float>")
