"""Structured filters: compiled from a list of conditions, or read from a query's text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATIONS = {
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(list(v) if isinstance(v, (list, tuple, set)) else [v]),
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
}


def predicate(columns: list[str], conditions: list[dict]) -> Column:
    """All conditions together. Unknown fields and operations are skipped; null never matches, but differs from any value."""
    known = [c for c in conditions if c["field"] in columns and c["op"] in _OPERATIONS]
    return reduce(lambda a, b: a & b, (F.coalesce(_OPERATIONS[c["op"]](F.col(c["field"]), c["value"]), F.lit(False)) for c in known), F.lit(True))


def filtered(df: DataFrame, conditions: list[dict]) -> DataFrame:
    return df.where(predicate(df.columns, conditions))


def parsed(query: Column, ranges: bool = False) -> Column:
    """array of (field, op, value) read from a text. ``ranges`` turns before, after and since into comparisons."""
    low = F.lower(query)
    pattern = r"(from|in|since|before|after)\s+([0-9]{4})"
    year, word = F.nullif(F.regexp_extract(low, pattern, 2), F.lit("")), F.regexp_extract(low, pattern, 1)
    op = F.when(word == "before", "lt").when(word == "after", "gt").when(word == "since", "gte").otherwise("eq") if ranges else F.lit("eq")
    of = lambda field, op, value: F.struct(F.lit(field).alias("field"), op.alias("op"), value.alias("value"))
    outdoor, indoor = F.contains(low, F.lit("outdoor")) | F.contains(query, F.lit("室外")), F.contains(low, F.lit("indoor")) | F.contains(query, F.lit("室内"))
    found = F.array(F.when(year.isNotNull(), of("year", op, year)), F.when(outdoor, of("scene", F.lit("eq"), F.lit("outdoor"))), F.when(indoor, of("scene", F.lit("eq"), F.lit("indoor"))))
    return F.filter(found, lambda x: x.isNotNull())


def scores(queries: DataFrame, items: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """q_id, id, meta: 1 where an item meets all of a query's conditions, or the query has none; else 0.

    Only pairs of ``candidates`` (q_id, id) are scored if they are given; one without an item gets 0. A field that items
    lack is skipped.
    """
    asked = queries.select("q_id", parsed(F.col("text")).alias("conditions"))
    items = items.withColumn("_known", F.lit(True))
    pairs = asked.crossJoin(items) if candidates is None else candidates.select("q_id", "id").join(asked, "q_id").join(items, "id", "left")

    def meets(c: Column) -> Column:
        out = F.lit(True)
        for field in ("year", "scene"):
            if field in items.columns:
                out = F.when(c["field"] == field, F.coalesce(F.col(field).cast("string") == c["value"], F.lit(False))).otherwise(out)
        return out

    return pairs.select("q_id", "id", (F.col("_known").isNotNull() & F.forall("conditions", meets)).cast("double").alias("meta"))
