"""A navigable small-world graph in shards: nodes and edges as one table, a hierarchical graph a shard, results merged.

Vectors are dealt to shards by the nearest of as many centres as there are shards, found by rounds over all of them, and a
centre with too many is several shards. So building and searching are tasks of bounded memory, and a query visits only
the shards whose centres are nearest. A shard's centre lies on one of its rows, so the nodes are the routing table too.

A whole shard is filled at once: a node's candidates are the exact nearest of those before it, from blocks of distances,
where single insertion finds them by a beam. Later vectors come as shards of their own (``later``); ``compacted`` inserts
them one by one into the shards nearest to them, and deals those that have grown too large anew.
"""

from __future__ import annotations

import heapq
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators.ann.kmeans import Lists, assigned, distances, first_centres, lloyd, scaled
from lodestone.operators.dense import matrix
from lodestone.operators.ranking import top
from lodestone.session import importable, stored

#: Vectors of a shard, about, and of a block of distances.
SHARD, FILL = 20_000, 512
#: Rounds over all vectors that place the centres; shards that a query visits; its queries that a shard answers at once.
ROUNDS, VISIT, QUERIES = 3, 8, 20_000
#: Shards up to which they are looked for in the row groups of the stored nodes.
FEW_SHARDS = 1000

NODES = "shard int, id bigint, level int, embedding array<float>, links array<struct<level:int,to:array<bigint>>>, centre array<float>"
KIND = pa.list_(pa.struct([("level", pa.int32()), ("to", pa.list_(pa.int64()))]))


def level_of(number: int, scale: float, seed: int = 42) -> int:
    """floor(-ln u * scale) with u drawn from a seeded hash of the id."""
    u = (xxhash.xxh64_intdigest(str(number), seed) + 1) / 2.0**64
    return floor(-log(u) * scale)


class Graph:
    """Nodes by position in the shard; links[level][node] is a list of positions."""

    def __init__(self, x: np.ndarray, links: int = DEFAULT.graph_links, metric: str = "cosine"):
        self.x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10) if metric == "cosine" else x
        self.cosine, self.m = metric == "cosine", links
        self.links: list[dict[int, list[int]]] = []
        self.start = -1

    def far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return 1.0 - self.x[nodes] @ q if self.cosine else np.sqrt(((self.x[nodes] - q) ** 2).sum(1))

    def beam(self, q: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes found, in order: the nearest open node is always visited next."""
        seen = set(starts)
        open_ = [(d, n) for d, n in zip(self.far(q, starts).tolist(), starts, strict=True)]
        heapq.heapify(open_)
        best = [(-d, -n) for d, n in open_]
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [n for n in self.links[level].get(node, ()) if n not in seen]
            seen.update(new)
            for d, n in zip(self.far(q, new).tolist() if new else (), new, strict=True):
                if len(best) < width or d < -best[0][0]:
                    heapq.heappush(open_, (d, n))
                    heapq.heappush(best, (-d, -n))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def chosen(self, q: np.ndarray, found: list[tuple[float, int]], m: int) -> list[int]:
        """Neighbours nearer to the new node than to those already chosen, filled up with the nearest others. ``found`` is in order."""
        nodes = np.array([n for _, n in found], np.int64)
        return self.diverse(nodes, np.array([d for d, _ in found]), m)

    def diverse(self, nodes: np.ndarray, far: np.ndarray, m: int) -> list[int]:
        if len(nodes) <= 1:
            return nodes.tolist()
        keep, open_ = [], np.ones(len(nodes), bool)
        while len(keep) < m and open_.any():
            at = int(open_.argmax())
            keep.append(at)
            open_[at] = False
            open_ &= self.far(self.x[nodes[at]], nodes) > far
        rest = np.setdiff1d(np.arange(len(nodes)), keep)[: m - len(keep)]
        return nodes[[*keep, *rest.tolist()]].tolist()

    def fill(self, levels: list[int], beam: int) -> None:
        """Inserts all nodes in order into an empty graph. Lists are cut when half as long again as they may be, and at the end."""
        levels = np.array(levels)
        for level in range(int(levels.max()) + 1):
            nodes = np.flatnonzero(levels >= level)
            links, most = {int(n): [] for n in nodes}, 2 * self.m if level == 0 else self.m

            def cut(n: int, links=links, most=most) -> None:
                own = np.array(links[n], np.int64)
                far = self.far(self.x[n], own)
                order = np.lexsort((own, far))
                links[n] = self.diverse(own[order], far[order], most)

            for first in range(0, len(nodes), FILL):
                block, before = nodes[first : first + FILL], nodes[: first + FILL]
                far = 1.0 - self.x[block] @ self.x[before].T if self.cosine else np.sqrt(distances(self.x[block], self.x[before]))
                for i, node in enumerate(block.tolist()):
                    row = far[i, : first + i]
                    near = np.argpartition(row, beam)[:beam] if len(row) > beam else np.arange(len(row))
                    near = near[np.lexsort((near, row[near]))]
                    links[node] = self.diverse(before[near], row[near], self.m)
                    for n in links[node]:
                        links[n].append(node)
                        if len(links[n]) > most + most // 2:
                            cut(n)
            for n, own in links.items():
                if len(own) > most:
                    cut(n)
            self.links.append(links)
        self.top = int(levels.max())
        self.start = int(np.flatnonzero(levels == self.top)[0])

    def insert(self, node: int, level: int, beam: int) -> None:
        while len(self.links) <= level:
            self.links.append({})
        q, entry = self.x[node], [self.start]
        if self.start < 0:
            for at in range(level + 1):
                self.links[at][node] = []
            self.start, self.top = node, level
            return
        for at in range(self.top, level, -1):
            entry = [self.beam(q, entry, 1, at)[0][1]]
        for at in range(min(level, self.top), -1, -1):
            found = self.beam(q, entry, beam, at)
            near = self.chosen(q, found, self.m)
            self.links[at][node] = near
            for n in near:
                own = self.links[at].setdefault(n, [])
                own.append(node)
                most = 2 * self.m if at == 0 else self.m
                if len(own) > most:
                    ranked = sorted(zip(self.far(self.x[n], own).tolist(), own, strict=True))
                    self.links[at][n] = self.chosen(self.x[n], ranked, most)
            entry = [n for _, n in found]
        for at in range(self.top + 1, level + 1):
            self.links[at][node] = []
        if level > self.top:
            self.start, self.top = node, level

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        if self.start < 0:
            return []
        q = q / (np.linalg.norm(q) + 1e-10) if self.cosine else q
        entry = [self.start]
        for at in range(self.top, 0, -1):
            entry = [self.beam(q, entry, 1, at)[0][1]]
        return self.beam(q, entry, max(beam, k), 0)[:k]


def _table(graph: Graph, shard: pa.Array, ids: np.ndarray, levels: list[int], vectors: pa.Array) -> pa.Table:
    """The rows of one shard. The first has the mean of the shard's vectors, as the graph scales them."""
    links = [[{"level": at, "to": ids[graph.links[at][n]].tolist()} for at in range(levels[n] + 1)] for n in range(len(ids))]
    centre = [graph.x.mean(0).tolist(), *[None] * (len(ids) - 1)]
    columns = [shard, pa.array(ids), pa.array(levels, pa.int32()), vectors, pa.array(links, KIND), pa.array(centre, pa.list_(pa.float32()))]
    return pa.table(columns, ["shard", "id", "level", "embedding", "links", "centre"])


def _restored(own: pa.Table, links: int, metric: str, more: np.ndarray | None = None) -> tuple[Graph, np.ndarray, list[int]]:
    """The graph of a shard's rows, its ids and levels; ``more`` vectors are room for later nodes."""
    own = own.sort_by("id").combine_chunks()
    ids, levels = own["id"].to_numpy(), own["level"].to_pylist()
    x = matrix(own["embedding"].chunk(0))
    graph = Graph(x if more is None else np.concatenate([x, more]), links, metric)
    graph.top = max(levels)
    graph.start = levels.index(graph.top)
    graph.links = [{} for _ in range(graph.top + 1)]
    each = own["links"].chunk(0)
    node = np.repeat(np.arange(len(ids)), each.value_lengths().to_numpy()).tolist()
    level, to = (each.flatten().field(name) for name in ("level", "to"))
    ends = np.concatenate([[0], to.value_lengths().to_numpy().cumsum()]).tolist()
    flat = np.searchsorted(ids, to.flatten().to_numpy()).tolist()
    for i, (n, at) in enumerate(zip(node, level.to_pylist(), strict=True)):
        graph.links[at][n] = flat[ends[i] : ends[i + 1]]
    return graph, ids, levels


def _dealt(rows: DataFrame, shard: int, metric: str, first: int) -> DataFrame:
    """id, embedding, shard: by nearest centre, and by a hash of the id where a centre has more than a shard's vectors."""
    n = rows.count()
    if n <= shard:
        return rows.withColumn("shard", F.lit(first))
    unit = metric == "cosine"
    centres = first_centres(rows, -(-n // shard))
    near = assigned(rows, lloyd(rows, scaled(centres) if unit else centres, ROUNDS, unit), unit, keep=True)
    at, deal = first, []
    for r in near.groupBy("list").count().orderBy("list").collect():  # a row for each centre
        parts = -(-r["count"] // shard)
        deal.append((r["list"], at, parts))
        at += parts
    known = rows.sparkSession.createDataFrame(deal, "list int, first int, parts int")
    return near.join(F.broadcast(known), "list").select("id", "embedding", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"))


def build(vectors: DataFrame, links: int = DEFAULT.graph_links, beam: int = DEFAULT.graph_build_beam, scale: float = DEFAULT.graph_level_scale, metric: str = "cosine", shard: int = SHARD, first: int = 0) -> DataFrame:
    """shard, id, level, embedding, links: array of (level, neighbours) of every vector, and on one row a shard its centre. Shards count from ``first``."""
    importable(vectors.sparkSession)
    rows = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table["id"].to_numpy()
        graph = Graph(matrix(table["embedding"].chunk(0)), links, metric)
        levels = [level_of(int(n), scale) for n in ids]
        graph.fill(levels, beam)
        return _table(graph, table["shard"], ids, levels, table["embedding"])

    return _dealt(rows, shard, metric, first).groupBy("shard").applyInArrow(run, NODES)


def centres_of(nodes: DataFrame) -> tuple[np.ndarray, Lists]:
    """The numbers of the shards and their centres: a row for some 20,000 vectors."""
    rows = nodes.where(F.col("centre").isNotNull()).select("shard", "centre").orderBy("shard").collect()
    return np.array([r["shard"] for r in rows], np.int32), Lists(np.array([r["centre"] for r in rows], np.float64))


def routed(queries: DataFrame, nodes: DataFrame, visit: int = VISIT, metric: str = "cosine", key: str = "q_id") -> DataFrame:
    """key, shard, embedding: each vector with the shards whose centres are nearest to it, ``visit`` at most."""
    shards, lists = centres_of(nodes)
    rows = queries.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<float>").alias("embedding"))
    if len(shards) <= visit:
        return rows.select(key, F.explode(F.array(*map(F.lit, shards.tolist())).cast("array<int>")).alias("shard"), "embedding")

    def run(batches):
        for batch in batches:
            x = matrix(batch["embedding"], lists.centres.shape[1])
            near = lists.probes(scaled(x) if metric == "cosine" else x, visit)
            row = pa.array(np.repeat(np.arange(len(x)), visit))
            yield pa.RecordBatch.from_arrays([batch[key].take(row), pa.array(shards[near.ravel()]), batch["embedding"].take(row)], [key, "shard", "embedding"])

    return rows.mapInArrow(run, f"{key} bigint, shard int, embedding array<float>")


def search(queries: DataFrame, nodes: DataFrame, k: int, visit: int = VISIT, beam: int = DEFAULT.graph_search_beam, links: int = DEFAULT.graph_links, metric: str = "cosine") -> DataFrame:
    """q_id, id, score, rank: the nearest of the visited shards, merged. ``nodes`` should be a stored table.

    Only visited shards move, once for every QUERIES of their queries, so that no task answers more.
    """
    importable(queries.sparkSession)
    sent = routed(queries, nodes, visit, metric)
    asked = {r["shard"]: -(-r["count"] // QUERIES) for r in sent.groupBy("shard").count().collect()}  # a row for each shard
    empty = queries.sparkSession.createDataFrame(sorted(asked.items()), "shard int, parts int")
    visited = nodes.where(F.col("shard").isin(sorted(asked))) if len(asked) <= FEW_SHARDS else nodes
    parts = F.broadcast(empty)
    held = visited.select("shard", "id", "level", "embedding", "links").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = sent.join(parts, "shard").select("q_id", "shard", "embedding", F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int").alias("part"))

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and ask.num_rows:
            graph, ids, _ = _restored(own, links, metric)
            asked = matrix(ask["embedding"].combine_chunks())
            found = [(q, int(ids[n]), 1.0 - d if metric == "cosine" else -d) for q, v in zip(ask["q_id"].to_pylist(), asked, strict=True) for d, n in graph.search(v, k, beam)]
        return pa.table({"q_id": pa.array([f[0] for f in found], pa.int64()), "id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    return top(held.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(run, "q_id bigint, id bigint, score double"), k)


def later(vectors: DataFrame, nodes: DataFrame, **parameters) -> DataFrame:
    """Nodes of further vectors, in shards of their own behind those there are. Ids that are there already keep their vectors."""
    new = vectors.join(nodes.select("id"), "id", "left_anti")
    return build(stored(new), first=(nodes.agg(F.max("shard")).first()[0] or 0) + 1, **parameters)


def compacted(nodes: DataFrame, first_late: int, links: int = DEFAULT.graph_links, beam: int = DEFAULT.graph_build_beam, scale: float = DEFAULT.graph_level_scale, metric: str = "cosine", shard: int = SHARD) -> DataFrame:
    """Nodes in which the shards from ``first_late`` on are dissolved. ``nodes`` should be a stored table.

    Each of their vectors is inserted by a beam into the shard whose centre is nearest. Shards that would hold more than
    twice what they should are dealt anew with what came to them, others that nothing comes to stay as they are.
    """
    importable(nodes.sparkSession)
    main, late = nodes.where(F.col("shard") < first_late), nodes.where(F.col("shard") >= first_late)
    to = routed(late.select("id", "embedding"), main, 1, metric, key="id")
    had = {r["shard"]: r["count"] for r in main.groupBy("shard").count().collect()}  # a row for each shard
    come = {r["shard"]: r["count"] for r in to.groupBy("shard").count().collect()}
    grown = [s for s, n in come.items() if had[s] + n > 2 * shard]
    few = [s for s in come if s not in set(grown)]
    both = lambda some: main.where(F.col("shard").isin(some)).select("id", "embedding").unionByName(to.where(F.col("shard").isin(some)).select("id", "embedding"))

    def run(own: pa.Table, new: pa.Table) -> pa.Table:
        new = new.sort_by("id").combine_chunks()
        graph, ids, levels = _restored(own, links, metric, matrix(new["embedding"].chunk(0)))
        for i, number in enumerate(new["id"].to_pylist()):
            levels.append(level_of(number, scale))
            graph.insert(len(ids) + i, levels[-1], beam)
        vectors = pa.concat_arrays([own.sort_by("id")["embedding"].combine_chunks(), new["embedding"].combine_chunks()])
        ids = np.concatenate([ids, new["id"].to_numpy()])
        return _table(graph, pa.array(np.full(len(ids), own["shard"][0].as_py()), pa.int32()), ids, levels, vectors)

    out = main.where(~F.col("shard").isin([*few, *grown])) if come else main
    if few:
        out = out.unionByName(main.where(F.col("shard").isin(few)).groupBy("shard").cogroup(to.where(F.col("shard").isin(few)).groupBy("shard")).applyInArrow(run, NODES))
    if grown:
        out = out.unionByName(build(stored(both(grown)), links, beam, scale, metric, shard, first=max(had) + 1))
    return out
