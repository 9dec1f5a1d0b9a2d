"""Operator 10: benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window of a text, of as many words as a benchmark item has (or the whole text, if it is shorter), leaks the item if
the weighted Jaccard similarity of their five-word shingles, as multisets, is 0.8 or more.

1. Windows. The best window of an item begins at one of its shingles or ends the text, and holds most of them. So a
   window of a size is made only where it begins so and holds enough shingles of the items *of that size* together;
   no other can be similar to any of them. Which item it may be is not known here.
2. Proposal. Every distinct window has a SimHash of its shingles. 64 bits are 16 blocks of 4, and an item is listed
   under its size and every block value up to one bit away; windows are looked up by size and blocks alone. Whatever is
   within 31 bits shares an entry, since 32 differing bits at least are needed to have two in each of 16 blocks.
3. Verification. What was proposed and is within the radius is decided by exact similarity, once for each distinct
   window; the places where the window stands are joined last.

Words are lower-cased and are runs other than blank and \\t to \\r. An item of fewer than five words is one shingle and
is leaked only by texts as short. Nulls and empty texts leak nothing and are not leaked. Rows that repeat an id are
reported once, with the best similarity of any; so are those whose id is null. Items without an id are reported under
null, repeated items once under each of their ids. Other columns are not read.

A passage that many documents share gives rows in proportion to those documents; documents are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, stored, texts_of

SHINGLE, SIMILARITY = 5, 0.8
#: The radius is the largest that the blocks guarantee. At similarity 0.8 a bit differs with a chance of 0.15 to 0.19, so
#: 10 to 12 of 64 do, give or take 3; 31 is six deviations off.
RADIUS, BLOCKS = 31, 16
#: Shingles of the benchmark up to which they are sent to every executor; beyond, texts' shingles are exchanged.
BROADCAST_SHINGLES = 2_000_000
#: Of shared shingles at most so many are stepped over.
MOST_STEP = 4
UNIT = 1 << 32


def _line(text: Column) -> Column:
    """Lower case, one blank between words, none outside. Single blanks, which most are, don't match and stay."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))


def _once(column: Column) -> Column:
    """Made in a generator, so that neither a filter nor another expression on it makes it again."""
    return F.explode(F.array(column))


def _with_shingles(df: DataFrame, step: int = 0) -> DataFrame:
    """In place of ``text``, ``shingles``: every run of five words, in order and with repeats; a shorter text as a whole.

    Zero-width matches at the starts of words capture what follows, which is cheaper than slices of an array of words.
    With a step a match takes up so many words, which leaves the runs at places 0, step, 2 * step and so on.
    """
    others = [c for c in df.columns if c != "text"]
    on = rf"[^ ]++(?: [^ ]++){{{step - 1}}}" if step else ""
    runs = F.regexp_extract_all("line", F.lit(rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{SHINGLE - 1}}})){on}"), F.lit(1))
    long = F.col("line").rlike(rf"^[^ ]++(?: [^ ]++){{{SHINGLE - 1}}}")
    shingles = F.when(long, runs).when(F.col("line") != "", F.array("line")).otherwise(F.array().cast("array<string>"))
    return df.select(*others, _once(_line(F.col("text"))).alias("line")).select(*others, _once(shingles).alias("shingles"))


def _hashes(shingles: str) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def _simhash(hashes: str) -> Column:
    """64 bits as a long: set where over half of the hashes, an array of longs, have them."""
    half = F.size(hashes)
    ones = lambda i: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1)).cast("int"))
    out = F.lit(0).cast("long")
    for i in range(64):
        out = out.bitwiseOR(F.when(ones(i) * 2 > half, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(print_: Column, flips: list[int]) -> Column:
    """(block, value) of each block of the fingerprint, also with the given bits of it flipped."""
    width = 64 // BLOCKS
    value = lambda i: F.shiftrightunsigned(print_, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("block"), value(i).bitwiseXOR(F.lit(x)).alias("value")) for i in range(BLOCKS) for x in flips])


def _first_agreeing(apart: Column) -> Column:
    """The first block that at most one of the differing bits lies in: where a pair meets in several, it is told there alone."""
    width = 64 // BLOCKS
    bits = lambda i: F.bit_count(F.shiftrightunsigned(apart, i * width).bitwiseAND(F.lit((1 << width) - 1)))
    return F.coalesce(*[F.when(bits(i) <= 1, F.lit(i)) for i in range(BLOCKS)])


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item (hashes of its shingles), m (their number), told (the hash of them all, which stands for the text)."""
    texts = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _with_shingles(texts).select("item_id", _hashes("shingles").alias("item")).withColumn("m", F.size("item")).where(F.col("m") > 0).withColumn("told", F.xxhash64("item"))


def _bounded(df: DataFrame, size: int) -> DataFrame:
    """Sent to every executor if the benchmark's size allows it, else joined by exchange."""
    return F.broadcast(df) if size <= BROADCAST_SHINGLES else df


def _near(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The texts that have a shared shingle among every ``step``-th of theirs: no other can leak.

    A leaking window misses at most m - ceil(8 m / 9) of its shingles, so the others, 0.8 m at least, have a run of
    0.8 m / (misses + 1), and a step that is no longer than the run meets it.
    """
    misses = F.col("m") - F.ceil(F.col("m") * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    run = items.agg(F.min(F.ceil(SIMILARITY * F.col("m") / (misses + 1) - 1e-6))).first()[0]
    step = max(1, min(MOST_STEP, int(run or 1)))
    wanted = items.select(F.explode("item").alias("h")).distinct()
    tried = _with_shingles(docs.select("row", "text"), step).select("row", F.explode("shingles").alias("shingle"))
    rows = tried.select("row", F.xxhash64("shingle").alias("h")).join(_bounded(wanted, size), "h", "left_semi").select("row").distinct()
    return stored(docs.join(stored(rows), "row", "left_semi"))


def _windows(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """row, m, start, tail (it ends the text): windows of m shingles with enough of those that the items of m have.

    Of multisets of m and w shingles, similarity s needs s (m + w) / (1 + s) in common.
    """
    wanted = _bounded(items.select("m", F.explode("item").alias("h")).distinct(), size)
    every = _with_shingles(docs.select("row", "text")).select("row", F.size("shingles").alias("n"), F.posexplode("shingles").alias("place", "shingle"))
    hits = every.select("row", "n", "place", F.xxhash64("shingle").alias("h")).join(wanted, "h").drop("h")
    sized = Window.partitionBy("row", "m")
    # The hits of the window that begins at each hit: places up to m - 1 on, that is less than UNIT in units of m / UNIT.
    ahead = sized.orderBy(F.expr(f"(CAST(place AS BIGINT) * {UNIT}) div m")).rangeBetween(0, UNIT - 2)
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    counted = hits.withColumn("held", F.count("*").over(ahead)).withColumn("ending", F.count(F.when(F.col("place") >= last, 1)).over(sized))
    need = F.ceil((F.col("m") + F.least("m", "n")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    enough = counted.where(F.when(F.col("place") > last, F.col("ending")).otherwise(F.col("held")) >= need)
    return enough.select("row", "m", F.least("place", last).alias("start"), (F.col("place") >= last).alias("tail")).distinct()


def _proposed(windows: DataFrame, items: DataFrame) -> DataFrame:
    """m, key, print, told: distinct windows with items of their size that share a block and are within the radius, each pair once."""
    listed = items.withColumn("item_print", _simhash("item")).select("m", "told", "item_print", F.explode(_blocks(F.col("item_print"), [0, *(1 << b for b in range(64 // BLOCKS))])).alias("at"))
    asked = windows.select("m", "key", "print", F.explode(_blocks(F.col("print"), [0])).alias("at"))
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    met = asked.join(listed, ["m", "at"]).where((F.bit_count(apart) <= RADIUS) & (F.col("at.block") == _first_agreeing(apart)))
    return met.select("m", "key", "print", "told")


def _verified(windows: DataFrame, proposed: DataFrame, items: DataFrame) -> DataFrame:
    """m, key, print, told, similarity, begins (at a shingle of the item) of what is similar enough."""
    key = ["m", "key", "print"]
    own = windows.join(proposed, key).select(*key, "told", F.size("h").alias("w"), F.posexplode("h").alias("place", "shingle"))
    own = own.groupBy(*key, "told", "w", "shingle").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    theirs = items.select("told", "m", F.explode("item").alias("shingle")).groupBy("told", "m", "shingle").agg(F.count("*").alias("k"))
    common = own.join(theirs, ["told", "m", "shingle"]).groupBy(*key, "told", "w").agg(F.sum(F.least("n", "k")).alias("common"), (F.min("place") == 0).alias("begins"))
    return common.withColumn("similarity", F.col("common") / (F.col("m") + F.col("w") - F.col("common"))).where(F.col("similarity") >= SIMILARITY)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, similarity (that of the best window), n_windows: one row for each leaking document and item.

    n_windows counts windows that leak and begin at a shingle of the item or end the text.
    """
    found = _leaking(df, benchmark, id_col, text_col, item_col, item_text)
    return found.groupBy("id", "item_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_windows"))


def _row(id_: Column, text: Column) -> Column:
    """The key of a row by id and text."""
    return F.xxhash64(id_, text)


def _leaking(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, row (its key), item_id, start, similarity, of every window that leaks."""
    listed = stored(items_of(benchmark, item_col, item_text))
    items = stored(listed.groupBy("m", "told").agg(F.first("item").alias("item")))  # equal texts once, whatever their ids
    docs = texts_of(df, id_col, text_col).where(F.col("text").isNotNull()).withColumn("row", _row(F.col("id"), F.col("text")))
    size = items.agg(F.sum("m")).first()[0] or 0
    docs = _near(docs, items, size)
    asked = _windows(docs, items, size).groupBy("row").agg(F.collect_list(F.struct("m", "start", "tail")).alias("windows"))
    cut = _with_shingles(docs.join(asked, "row").select("id", "row", "windows", "text")).select("id", "row", "windows", _once(_hashes("shingles")).alias("h"))
    cut = cut.select("id", "row", "h", F.explode("windows").alias("w"))
    cut = cut.select("id", "row", "w.*", F.slice("h", F.col("w.start") + 1, F.col("w.m")).alias("h")).withColumn("key", F.xxhash64("h"))
    cut = stored(cut.withColumn("print", _simhash("h")))
    windows = stored(cut.groupBy("m", "key", "print").agg(F.first("h").alias("h")))
    found = stored(_verified(windows, _proposed(windows, items), items))
    places = cut.select("id", "row", "m", "start", "tail", "key", "print").distinct()
    found = found.join(listed.select("m", "told", "item_id").distinct(), ["m", "told"])
    return places.join(found, ["m", "key", "print"]).where("begins OR tail").select("id", "row", "item_id", "start", "similarity")


def without_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged, that leak no item. Rows are told apart by id, null or not, and text."""
    row, own, own_row = (free_name(df, c) for c in ("row", "leaking_id", "leaking_row"))
    gone = _leaking(df, benchmark, id_col, text_col).select(F.col("id").alias(own), F.col("row").alias(own_row)).distinct()
    keyed = df.withColumn(row, _row(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")))
    left = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(row) == F.col(own_row)), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
