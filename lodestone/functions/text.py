"""Text expressions, all of them built-in functions."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What cleaning keeps, which is Latin letters, digits, white space, a few marks and common ideographs.
KEPT_MARKS, KEPT_RANGE = ".,!?'", "一-鿿"
#: All else. Java looks single Latin characters of a class up in one set, but tries ranges one after the other.
LEFT_OUT = f"[^{ascii_letters}{digits} \t\n\x0b\f\r{KEPT_MARKS}{KEPT_RANGE}]"

#: Fixed value: labels that may stand before a translation.
LABEL = r"(?i)^(english translation:|translation:|english:)\s*"


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; null gives null."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def cleaned(caption: Column) -> Column:
    return F.regexp_replace(F.lower(caption), LEFT_OUT, "")


def path_of(directory: str, key: Column, extension: str = ".jpg", pad: int = 0) -> Column:
    """directory/key.ext; ``pad`` fills numeric keys with zeros."""
    name = key.cast("string")
    return F.concat(F.lit(directory.rstrip("/") + "/"), F.lpad(name, pad, "0") if pad else name, F.lit(extension))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike("[一-鿿]"), F.lit(False))


def without_label(text: Column) -> Column:
    """A translation without the label that a generator may put before it."""
    return F.trim(F.regexp_replace(F.trim(text), LABEL, ""))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns; stray % and braces in values are left alone."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def fenced_json(reply: Column, schema) -> Column:
    """The object in a reply, which may stand in a code fence."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)```", 1)
    return F.from_json(F.trim(F.when(F.contains(reply, F.lit("```")), fenced).otherwise(reply)), schema)
