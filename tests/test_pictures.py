"""Pictures by their pixels: one that was encoded anew is found by the other."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.sources import pictures as P


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Some pictures, the same in other formats and sizes, and files that are none."""
    first, other = tmp_path_factory.mktemp("first"), tmp_path_factory.mktemp("other")
    rng, jvm = np.random.default_rng(2), spark._jvm
    for i in range(24):
        y, x = np.mgrid[0:48, 0:64] / 48
        waves = [np.sin(a * x + b * y + c) for a, b, c in rng.uniform(1, 7, (3, 3))]
        pixels = np.stack(waves, 2) * 100 + 128
        (first / f"{i}.png").write_bytes(png(pixels))
        if i % 3 == 2:
            (other / f"{i}.png").write_bytes(png(np.repeat(np.repeat(pixels, 3, axis=0), 2, axis=1)))
        else:
            kind = ("jpg", "bmp")[i % 3]
            read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(first / f"{i}.png")))
            assert jvm.javax.imageio.ImageIO.write(read, kind, jvm.java.io.File(str(other / f"{i}.{kind}")))
    (first / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno picture")
    (first / "text.jpg").write_bytes(b"words")
    return str(first), str(other)


def test_pixels(spark, folders):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in P.pictures(spark, folders[0]).collect()}
    assert len(rows) == 26 and (rows["0.png"]["height"], rows["0.png"]["width"], rows["0.png"]["channels"]) == (48, 64, 3)
    assert rows["broken.png"]["data"] is rows["text.jpg"]["data"] is rows["text.jpg"]["height"] is None


def test_other_encodings_are_found(spark, folders):
    number = F.regexp_extract("path", r"(\w+)\.\w+$", 1)
    have = P.picture_vectors(P.pictures(spark, folders[0])).withColumn("name", number)
    none = {r["name"]: r["embedding"] for r in have.where("name IN ('broken', 'text')").collect()}
    assert none == {"broken": [0.0] * P.WIDTH, "text": [0.0] * P.WIDTH}
    have = have.where("name RLIKE '^[0-9]+$'").select(F.col("name").cast("long").alias("id"), "embedding")
    asked = P.picture_vectors(P.pictures(spark, folders[1])).select(number.cast("long").alias("q_id"), "embedding")
    found = dense.exact_topk(asked, have, 1).collect()
    assert len(found) == 24 and all(r["q_id"] == r["id"] and r["score"] > 0.99 for r in found)


def test_shapes():
    rng = np.random.default_rng(0)
    for shape in [(1, 1, 3), (3, 200, 1), (9, 7, 4), (224, 224, 3)]:
        vector = P.described(rng.integers(0, 256, shape))
        assert vector.shape == (P.WIDTH,) and np.linalg.norm(vector) == pytest.approx(1)
    assert not P.described(np.zeros((224, 224, 3))).any()
