"""Operator 8: near-duplicates by SimHash, compared exactly in tiles.

If two fingerprints differ in at most ``radius`` bits, the population counts of their words (four of 16 bits, eight of
8) differ by at most ``radius`` in sum. Distinct fingerprints therefore lie in cells of a grid over the counts of the
four words; each goes as a guest to those neighbouring cells that its counts can reach within the radius, and all other
cells are skipped. A cell's own fingerprints are cut into tiles and its guests into chunks of bounded size; one pair of
tile and chunk is one group, compared in full by exclusive or and bit counts, again skipping parts whose counts are too
far apart. The grid has at most 17^4 cells, whatever the input; with more fingerprints it gets finer and tiles larger,
and it is exact at any of these sizes.

A group gives a spanning forest of its links, never all pairs, so a cluster of thousands stays linear in rows. Links
join in components by distributed rounds; a document's component is the smallest id that it reaches.

Nulls and texts without words have fingerprint 0 and link like any other. Null ids never name a component unless all ids
of it are null. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from lodestone.llm.common import free_name, map_rows, stored, texts_of
from lodestone.llm.components import components
from lodestone.session import importable

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bounds of a tile; fingerprints from which the grid's bins take fewer counts; pairs that are compared at once.
LEAST_TILE, MOST_TILE, TILES, CHUNK = 1024, 65_536, 48, 4
WIDTHS = ((1 << 20, 4), (1 << 23, 2), (1 << 62, 1))
AT_ONCE = 1 << 20


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *(ends[: len(words) - SHINGLE]).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def prints_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns, and the fingerprint of the text as a signed long, ``print``."""
    at = df.columns.index(text_col)
    schema = StructType([*(f for f in df.schema.fields if f.name != text_col), StructField("print", LongType())])

    def start():
        return lambda batch: batch.append_column("print", pa.array([signed(fingerprint(t.as_py())) for t in batch.column(at)], pa.int64())).select(schema.names)

    return map_rows(df, start, schema)


class Grid:
    """Bins of the population counts of the four 16-bit words. Its size is bounded by 17^4 cells."""

    def __init__(self, width: int, radius: int):
        self.width, self.radius = width, radius
        reach = 0 if not radius else (radius - 1) // width + 1
        least = lambda o: (abs(o) - 1) * width + 1 if o else 0
        self.steps = [s for s in product(range(-reach, reach + 1), repeat=4) if sum(map(least, s)) <= radius]

    def counts(self, prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int64)

    @staticmethod
    def code(bins: np.ndarray) -> np.ndarray:
        return ((bins[..., 0] * 32 + bins[..., 1]) * 32 + bins[..., 2]) * 32 + bins[..., 3]

    def cells(self, prints: np.ndarray) -> np.ndarray:
        return self.code(self.counts(prints) // self.width)

    def guests(self, prints: np.ndarray):
        """(rows, cells): for each step the fingerprints that can have links in the cell there, other than their own."""
        counts = self.counts(prints)
        bins = counts // self.width
        for step in self.steps:
            if any(step):
                there = bins + np.array(step)
                far = np.maximum(there * self.width - counts, 0) + np.maximum(counts - there * self.width - self.width + 1, 0)
                at = np.flatnonzero((there >= 0).all(1) & (there <= 16 // self.width).all(1) & (far.sum(1) <= self.radius))
                yield at, self.code(there[at])


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels of linked rows until each pair has the same one."""
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _compare(every: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, parent: np.ndarray, bits: int = 16) -> None:
    """Joins whatever of a and of b (the same array: within it) differs in at most ``radius`` bits."""
    if len(a) * len(b) <= AT_ONCE or bits < 8:
        strip = max(1, AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), strip):
            x, y = np.nonzero(np.bitwise_count(every[a[at : at + strip], None] ^ every[b][None, :]) <= radius)
            if len(x):
                _union(parent, a[at + x], b[y])
        return
    words = 64 // bits

    def split(rows: np.ndarray):
        counts = np.bitwise_count(every[rows].view(f"<u{bits // 8}").reshape(-1, words))
        kinds, place = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        return kinds.astype(np.int16), np.split(rows[order], np.cumsum(np.bincount(place.ravel()))[:-1])

    kinds_a, parts_a = split(a)
    kinds_b, parts_b = (kinds_a, parts_a) if a is b else split(b)
    for i, kind in enumerate(kinds_a):
        for j in np.flatnonzero(np.abs(kinds_b - kind).sum(1) <= radius).tolist():
            if a is not b or j > i:
                _compare(every, parts_a[i], parts_b[j], radius, parent, bits // 2)
            elif i == j:
                _compare(every, parts_a[i], parts_a[i], radius, parent, bits // 2)


def forest(home: np.ndarray, guests: np.ndarray, radius: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the pairs of home and guests, and those within home, connect."""
    every = np.concatenate([home, guests])
    parent = np.arange(len(every))
    own = parent[: len(home)].copy()
    if within:
        _compare(every, own, own, radius, parent)
    if len(guests):
        _compare(every, own, np.arange(len(home), len(every)), radius, parent)
    at = np.flatnonzero(parent != np.arange(len(every)))
    return every[at], every[parent[at]]


def links(prints: DataFrame, column: str = "print", radius: int = RADIUS) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints."""
    importable(prints.sparkSession)
    prints = prints.select(F.col(column).alias("print"))
    total = prints.count()
    width = next(w for most, w in WIDTHS if total <= most)
    tile = min(MOST_TILE, max(LEAST_TILE, total // TILES))
    grid = Grid(width, radius)
    counted = lambda i: F.floor(F.bit_count(F.shiftrightunsigned("print", 16 * i).bitwiseAND(F.lit(0xFFFF))) / width).cast("int")
    sizes = {tuple(r)[:4]: r["n"] for r in prints.groupBy(*[counted(i).alias(f"c{i}") for i in range(4)]).agg(F.count("*").alias("n")).collect()}  # at most 17^4 rows
    plan = {}
    for cell, n in sizes.items():
        code = int(grid.code(np.array(cell)))
        near = sum(sizes.get(tuple(x + y for x, y in zip(cell, step, strict=True)), 0) for step in grid.steps)
        plan[code] = (-(-n // tile), -(-near // (CHUNK * tile)))
    known = np.array(sorted(plan), np.int64)
    tiles, chunks = (np.array([plan[c][i] for c in known.tolist()], np.int64) for i in (0, 1))

    def deal(batches):
        """group, side (0 home, 1 guest), print."""
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                own = batch["print"].slice(at, 20_000).to_numpy(zero_copy_only=False).view("<u8")
                mixed = (own ^ own >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
                tile_of, chunk_of = (mixed >> np.uint64(40)).astype(np.int64), (mixed >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.int64)
                keys, sides, rows = [], [], []

                def add(cell, i, k, side, which):
                    keys.append((cell << 40) | (i << 20) | k)  # noqa: B023
                    sides.append(np.full(len(which), side, np.int8))  # noqa: B023
                    rows.append(which)  # noqa: B023

                def every(counts):
                    """An index of what is repeated, and the number within each repetition."""
                    which = np.repeat(np.arange(len(counts)), counts)
                    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)

                cells = grid.cells(own)
                place = np.searchsorted(known, cells)
                mine, chunk = tile_of % tiles[place], chunk_of % chunks[place]
                which, k = every(chunks[place])
                add(cells[which], mine[which], k, 0, which)
                which, i = every(mine)  # tiles before one's own
                add(cells[which], i, chunk[which], 1, which)
                for at_, there in grid.guests(own):
                    place = np.minimum(np.searchsorted(known, there), len(known) - 1)
                    use = (known[place] == there) & (there > cells[at_])
                    at_, there, place = at_[use], there[use], place[use]
                    which, i = every(tiles[place])
                    add(there[which], i, (chunk_of[at_] % chunks[place])[which], 1, at_[which])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sides)), pa.array(own[np.concatenate(rows)].view(np.int64))], ["group", "side", "print"])

    def compare(table: pa.Table) -> pa.Table:
        found, side = table["print"].to_numpy().view("<u8"), table["side"].to_numpy()
        a, b = forest(found[side == 0], found[side == 1], radius, not table["group"][0].as_py() & 0xFFFFF)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(deal, "group bigint, side tinyint, print bigint").groupBy("group").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id, for every row; only distinct fingerprints are compared."""
    rows = stored(prints_of(texts_of(df, id_col, text_col)))
    prints = stored(rows.groupBy("print").agg(F.min("id").alias("least")))
    linked = prints.join(_roots(prints, radius), "print")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = prints.join(linked.select("print", "root"), "print", "left").join(least, "root", "left")
    told = found.select("print", F.coalesce("component", "least").alias("component_id"))
    return rows.join(told, "print", "left").select("id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """print, root (the fingerprint that stands for its component) of those fingerprints that have links."""
    found = components(links(prints, "print", radius)).withColumnRenamed("node", "print")
    return found.select("print", "root").unionByName(found.select(F.col("root").alias("print"), "root").distinct())


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of every component one row, with all columns unchanged: one of its smallest id, nulls last.

    Components are told apart by their root fingerprint and rows by 128 bits of id and text, so null and repeated ids of
    unrelated texts all stay. Fingerprints are made once; texts are exchanged once, after copies of a row within a task.
    """
    one, two, place, order = (free_name(df, c) for c in ("key_one", "key_two", "key_place", "key_order"))
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    keys = F.xxhash64(id_, text), F.xxhash64(text, F.lit(1), id_)
    rows = prints_of(df.select(id_.alias("id"), keys[0].alias("one"), keys[1].alias("two"), text.alias("text")))
    # Of every fingerprint its first row, and of every component the first of these.
    firsts = stored(rows.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "one", "two")).alias("first")))
    rooted = firsts.join(_roots(firsts.select("print"), radius), "print", "left")
    chosen = rooted.groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.one").alias(one), F.col("first.two").alias(two)).distinct()
    own = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    copies = Window.partitionBy(one, two).orderBy(order)
    keyed = df.withColumns({one: keys[0], two: keys[1], order: F.xxhash64(*own)})
    return keyed.withColumn(place, F.row_number().over(copies)).where(F.col(place) == 1).join(chosen, [one, two], "left_semi").drop(one, two, place, order)
