"""Layered proximity graphs: one per shard of bounded size, built and searched over whole arrays.

Vectors are dealt to shards by a hash of their id. In a shard each vector gets a random level (a hash of its id); layer l
links the vectors of level l and above to near and diverse neighbours, both ways, with at most ``m0`` links on the ground
layer and ``m`` above. A search walks greedily down from the top layer and keeps the ``ef`` best of the ground layer,
expanding the nearest that isn't expanded yet, for a whole chunk of queries at once. The best of all shards are merged.

The result is approximate; ``recall`` measures it. Removed ids stay in the graph as way points and are left out of results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.vector_batch import CELLS, _cut, matrix, ranked, store_queries
from lorespark.session import materialise


@dataclass(frozen=True)
class AnnParams:
    """Links above ground and on it, beams of building and searching, rows of a shard, and how neighbours are chosen."""

    m: int = 16
    m0: int = 32
    candidates: int = 64
    ef_search: int = 64
    shard_rows: int = 16_384
    diversify: bool = True
    most_levels: int = 10


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def levels(ids: np.ndarray, m: int, most: int) -> np.ndarray:
    """``floor(-ln u / ln m)`` for u in (0, 1] from a hash of the id."""
    u = (_mixed(_mixed(ids)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.floor(-np.log(1 - u) / np.log(max(m, 2))), most).astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def select(d: np.ndarray, between: np.ndarray, m: int, diversify: bool) -> np.ndarray:
    """Which candidates (in order of distance ``d``) each node keeps: the ``m`` nearest, or near and diverse ones.

    A candidate is diverse if it is nearer to the node than to any kept one; free places go to the nearest of the rest.
    """
    n, c = d.shape
    if not diversify:
        return np.broadcast_to(np.arange(c) < m, d.shape) & np.isfinite(d)
    keep = np.zeros((n, c), bool)
    for j in range(c):
        close = np.where(keep, between[:, j], np.inf).min(1)
        keep[:, j] = (d[:, j] <= close) & (keep.sum(1) < m) & np.isfinite(d[:, j])
    spare = (m - keep.sum(1))[:, None]
    rest = ~keep & np.isfinite(d)
    return keep | (rest & (np.cumsum(rest, axis=1) <= spare))


def _nearest(y: np.ndarray, rows: np.ndarray, among: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``c`` nearest of the first ``among`` rows, in order, without the row itself."""
    d = _squares(y[rows], y[:among])
    own = np.flatnonzero(rows < among)
    d[own, rows[own]] = np.inf
    near = np.argpartition(d, c - 1, axis=1)[:, :c]
    dn = np.take_along_axis(d, near, 1)
    order = np.argsort(dn, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)


def _choose(y: np.ndarray, near: np.ndarray, dn: np.ndarray, m: int, params: AnnParams) -> tuple[np.ndarray, np.ndarray]:
    found = []
    step = max(1, CELLS // max(near.shape[1] * max(near.shape[1], y.shape[1]), 1))  # a node of many links is weighed alone
    for a in range(0, len(near), step):
        z = y[near[a : a + step]]
        sq = (z * z).sum(2)
        between = sq[:, :, None] + sq[:, None] - 2 * (z @ z.transpose(0, 2, 1))
        r, k = np.nonzero(select(dn[a : a + step], between, m, params.diversify))
        found.append((r + a, k))
    return tuple(np.concatenate(x) for x in zip(*found))


def link(x: np.ndarray, nodes: np.ndarray, m: int, most: int, params: AnnParams) -> np.ndarray:
    """Links of ``nodes`` (rows of x, in an order that says nothing about them), as rows of x, padded with -1.

    As in insertion one by one, a node links to the nearest of the nodes before it (here: of the last power of two of
    them), which gives links across the whole set, and then to the nearest of all. Links go both ways; a node with too
    many keeps ``most`` by the same choice.
    """
    y, n = x[nodes], len(nodes)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    edges: list[np.ndarray] = []
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        near, dn = _nearest(y, rows, n, min(params.candidates, n - 1))
        r, k = _choose(y, near, dn, m, params)
        edges.append(np.stack([rows[r], near[r, k]]))
    size = 8
    while size < n:
        for a in range(size, min(2 * size, n), 256):
            rows = np.arange(a, min(a + 256, 2 * size, n))
            near, _ = _nearest(y, rows, size, min(4, size))
            edges.append(np.stack([np.repeat(rows, near.shape[1]), near.ravel()]))
        size *= 2
    src, dst = np.concatenate(edges, axis=1)
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = both // n, both % n
    d = np.concatenate([((y[src[a : a + (1 << 16)]] - y[dst[a : a + (1 << 16)]]) ** 2).sum(1) for a in range(0, len(src), 1 << 16)])
    order = np.lexsort([d, src])
    src, dst, d = src[order], dst[order], d[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    width = int(place.max()) + 1
    for a in range(0, n, 64):
        mine = slice(*np.searchsorted(src, [a, a + 64]))
        near, dn = np.zeros((min(64, n - a), width), np.int64), np.full((min(64, n - a), width), np.inf)
        near[src[mine] - a, place[mine]], dn[src[mine] - a, place[mine]] = dst[mine], d[mine]
        used = int(place[mine].max()) + 1
        r, k = _choose(y, near[:, :used], dn[:, :used], most, params)
        at = np.arange(len(r)) - np.searchsorted(r, r)
        out[a + r, at] = nodes[near[r, k]]
    return out


@dataclass
class Graph:
    ids: np.ndarray
    x: np.ndarray
    level: np.ndarray
    layers: list[np.ndarray]  # links per layer, a row per vector

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, params: AnnParams) -> Graph:
        level = levels(ids, params.m, params.most_levels)
        layers, order = [], np.argsort(_mixed(ids), kind="stable")
        for k in range(int(level.max()) + 1 if len(level) else 0):
            nodes = order[level[order] >= k]
            width = params.m if k else params.m0
            links = np.full((len(ids), width), -1, np.int32)
            links[nodes] = link(x, nodes, params.m, width, params)  # in hash order
            layers.append(links)
        return cls(ids, x, level, layers)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and squared distances of up to ``ef`` vectors for each query, not sorted."""
        n, asked = len(self.ids), np.arange(len(q))
        top = np.flatnonzero(self.level == self.level.max())
        d = _squares(q, self.x[top])
        at, dist = top[d.argmin(1)], d.min(1)
        for links in self.layers[:0:-1]:  # greedy descent
            live = asked
            while len(live):
                near, dn = self._neighbours(links, at[live], q[live])
                best = dn.argmin(1)
                better = dn[np.arange(len(live)), best] < dist[live]
                live, best, near, dn = live[better], best[better], near[better], dn[better]
                rows = np.arange(len(live))
                at[live], dist[live] = near[rows, best], dn[rows, best]
        ids, beam, done = np.full((len(q), ef), -1), np.full((len(q), ef), np.inf), np.zeros((len(q), ef), bool)
        ids[:, 0], beam[:, 0] = at, dist
        seen = np.zeros((len(q), n), bool)
        seen[asked, at] = True
        live = asked
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), np.inf, beam[live])
            pick = open_.argmin(1)
            some = np.isfinite(open_[np.arange(len(live)), pick])
            live, pick = live[some], pick[some]
            if not len(live):
                break
            done[live, pick] = True
            near, dn = self._neighbours(self.layers[0], ids[live, pick], q[live])
            old = seen[live[:, None], np.maximum(near, 0)] | (near < 0)
            r, c = np.nonzero(~old)
            seen[live[r], near[r, c]] = True
            dn[old] = np.inf
            all_d = np.concatenate([beam[live], dn], axis=1)
            keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            beam[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.where(np.isfinite(beam[live]), np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1), keep, 1)
        return ids, beam

    def _neighbours(self, links: np.ndarray, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = links[at].astype(np.int64)
        d = ((self.x[np.maximum(near, 0)] - q[:, None]) ** 2).sum(2)
        return near, np.where(near < 0, np.inf, d)


STORED = "shard int, id long, v array<double>, level int, links array<array<int>>"


def build_graph(vectors: DataFrame, params: AnnParams = AnnParams(), id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The stored index: a row per vector with its level and its links (as places in the shard's order of ids)."""
    rows = vectors.where(F.col(col).isNotNull()).dropDuplicates([id_col]).select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // params.shard_rows))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        g = Graph.build(table.column("id").to_numpy(), matrix(table.column("v")), params)
        links = [[layer[i][layer[i] >= 0].tolist() for layer in g.layers[: g.level[i] + 1]] for i in range(len(g.ids))]
        return pa.table([table.column("shard"), table.column("id"), table.column("v"), pa.array(g.level.astype(np.int32)), pa.array(links, pa.list_(pa.list_(pa.int32())))], ["shard", "id", "v", "level", "links"])

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return materialise(sharded.groupBy("shard").applyInArrow(build, STORED), "graph")  # a shard has about shard_rows rows


def load(table: pa.Table, params: AnnParams) -> Graph:
    """A shard's graph from its rows."""
    table = table.sort_by("id")
    level = table.column("level").to_numpy().astype(np.int64)
    layers = []
    rows = table.column("links").to_pylist()
    for k in range(int(level.max()) + 1):
        links = np.full((len(rows), params.m if k else params.m0), -1, np.int32)
        for i in np.flatnonzero(level >= k):
            links[i, : len(rows[i][k])] = rows[i][k]
        layers.append(links)
    return Graph(table.column("id").to_numpy(), matrix(table.column("v")), level, layers)


def search_graph(stored: DataFrame, vectors: DataFrame, which: Column, k: int, params: AnnParams = AnnParams(), removed: DataFrame | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score`` of the rows that ``which`` holds for; ``removed(id)`` are left out."""
    queries = store_queries(vectors, which, id_col, col)
    if queries is None:
        return stored.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    ef = max(params.ef_search, k)

    def run(table: pa.Table) -> pa.Table:
        g = load(table, params)
        out: list[tuple] = []
        # a search notes which rows it has seen, so fewer queries go at a time through a large shard
        for qid, q in _cut(queries.chunks(), max(1, CELLS // len(g.ids))):
            ids, d = g.search(q, min(ef, len(g.ids)))
            r, c = np.nonzero(ids >= 0)
            out.append((qid[r], g.ids[ids[r, c]], 1 / (1 + np.sqrt(d[r, c]))))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in cols], ["query_id", "id", "score"])

    hits = stored.groupBy("shard").applyInArrow(run, "query_id long, id long, score double")
    if removed is not None:
        hits = hits.join(removed.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
    return ranked(hits, k)

