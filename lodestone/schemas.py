"""Schemas of what is read and written, declared once."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


CAPTION_JSON = _struct(annotations=ArrayType(_struct(image_id=LongType(), caption=StringType(), id=LongType())))
CAPTIONS = _struct(image_id=StringType(), caption_pos=IntegerType(), caption=StringType())
EMBEDDINGS = _struct(vec_id=LongType(), embedding=ArrayType(FloatType()))
DEMO = _struct(image_id=IntegerType(), image_path=StringType(), caption=StringType(), scene=StringType(), year=IntegerType(), source=StringType())
RESULTS = _struct(q_id=LongType(), rank=IntegerType(), id=LongType(), score=DoubleType())
JUDGEMENT = _struct(relevance=IntegerType(), accuracy=IntegerType(), usefulness=IntegerType(), comment=StringType())
