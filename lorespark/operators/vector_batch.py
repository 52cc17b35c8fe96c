"""Searches of many queries against all vectors, block by block.

Queries are stored in the shared folder and read chunk by chunk by the tasks that hold the vectors, so neither side is
broadcast or collected. Each block of vectors gives every query its best rows; a window keeps the best of all blocks.
Scores are ranked by their value to nine digits, then by id.

Defined cases: null vectors, and vectors of another length than the first query, take no part; a query is a candidate of
its own search; fewer than k candidates are all returned; no queries or no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import codes
from lorespark.session import materialise, shared_path

CHUNK, BLOCK = 1024, 8192
#: Pairs that are scored at a time: a matrix of them is 16 MB.
CELLS = 1 << 21
OUT = "query_id long, id long, score double, coarse double"


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


@dataclass(frozen=True)
class StoredQueries:
    """``query_id, q`` in the shared folder, and the length of the vectors."""

    path: str
    dim: int
    extra: tuple[str, ...] = ()

    def chunks(self) -> Iterator[tuple]:
        fs, root = _fs(self.path)
        for info in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=CHUNK, columns=["query_id", "q", *self.extra]):
                        if len(b):
                            yield b.column(0).to_numpy(), matrix(b.column(1)), *(b.column(i) for i in range(2, 2 + len(self.extra)))


def store_queries(vectors: DataFrame, which: Column, id_col: str = "vec_id", col: str = "embedding") -> StoredQueries | None:
    """The rows that ``which`` holds for, as queries."""
    spark = vectors.sparkSession
    asked = vectors.where(which & F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(col).cast("array<double>").alias("q"))
    first = asked.orderBy("query_id").select(F.size("q").alias("n")).first()
    if first is None:
        return None
    path = shared_path(spark, "queries")
    asked.where(F.size("q") == first.n).write.parquet(path)
    return StoredQueries(path, first.n)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of everything at least as good as the k-th best of each row (ties included)."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else score.min(1)
    return np.nonzero(score >= least[:, None] - 1e-9)


Scorer = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def cosine(q: np.ndarray, x: np.ndarray, k: int):
    """Cosine; 0 where either has no length."""
    s = _unit(q) @ _unit(x).T
    r, c = _best(s, k)
    return r, c, s[r, c], s[r, c]


def l2(q: np.ndarray, x: np.ndarray, k: int):
    """``1 / (1 + distance)``."""
    s = 1 / (1 + distances(q, x))
    r, c = _best(s, k)
    return r, c, s[r, c], s[r, c]


def int8(q: np.ndarray, x: np.ndarray, k: int):
    """The same over eight-bit codes."""
    return l2(codes.eight_bit(q), codes.eight_bit(x), k)


def hamming(q: np.ndarray, x: np.ndarray, k: int):
    """Minus the number of components of different sign."""
    a, b = np.packbits(q >= 0, axis=1), np.packbits(x >= 0, axis=1)
    s = np.zeros((len(q), len(x)))
    for i in range(a.shape[1]):
        s -= np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    r, c = _best(s, k)
    return r, c, s[r, c], s[r, c]


def prefix(width: int, oversample: int = 4) -> Scorer:
    """Exact neighbours by way of the first ``width`` components.

    The distance of prefixes is never more than that of whole vectors. The ``oversample * k`` nearest prefixes give a
    k-th best whole distance; every row whose prefix lies within it is scored, so none is lost.
    """

    def score(q: np.ndarray, x: np.ndarray, k: int):
        return _completed(q, x, k, (d := distances(q[:, :width], x[:, :width])), d, oversample)

    return score


def sign_codes(oversample: int = 4) -> Scorer:
    """Exact neighbours by way of one-bit codes: their estimate orders, their lower bound completes."""

    def score(q: np.ndarray, x: np.ndarray, k: int):
        c = codes.SignCodes.of(x)
        return _completed(q, x, k, c.estimate(q), c.at_least(q), oversample)

    return score


def _completed(q: np.ndarray, x: np.ndarray, k: int, coarse: np.ndarray, low: np.ndarray, oversample: int):
    d = np.full(coarse.shape, np.inf)
    n = min(oversample * k, len(x))
    first = np.argpartition(coarse, n - 1, axis=1)[:, :n]
    rows = np.repeat(np.arange(len(q)), n)
    _exact(d, q, x, rows, first.ravel())
    kth = np.partition(d, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
    r, c = np.nonzero((low <= kth[:, None] + 1e-9) & np.isinf(d))
    _exact(d, q, x, r, c)
    s = 1 / (1 + d)
    r, c = _best(s, k)
    return r, c, s[r, c], s[r, c]


def _exact(d: np.ndarray, q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    step = max(1, CELLS // max(q.shape[1], 1) // 4)
    for a in range(0, len(r), step):
        z = slice(a, a + step)
        d[r[z], c[z]] = np.sqrt(((q[r[z]] - x[c[z]]) ** 2).sum(1))


def estimated(oversample: int) -> Scorer:
    """Approximate: the best ``oversample * k`` by the estimate of the one-bit codes, with their exact scores."""

    def score(q: np.ndarray, x: np.ndarray, k: int):
        est = -codes.SignCodes.of(x).estimate(q)
        r, c = _best(est, oversample * k)
        d = np.zeros(est.shape)
        _exact(d, q, x, r, c)
        return r, c, 1 / (1 + d[r, c]), est[r, c]

    return score


def search(vectors: DataFrame, queries: StoredQueries | None, k: int, scorer: Scorer = l2, id_col: str = "vec_id", col: str = "embedding", oversample: int | None = None, shards: int | None = None) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best rows of each query.

    With ``oversample`` the best ``oversample * k`` by the coarse score are kept first (see ``estimated``); with ``shards``
    (id modulo) the best of each shard, then of all.
    """
    spark = vectors.sparkSession
    if queries is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dim = queries.dim
    rows = vectors.where(F.col(col).isNotNull() & (F.size(col) == dim)).select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches):
            for qid, q in _cut(queries.chunks(), max(1, CELLS // len(x))):
                r, c, s, coarse = scorer(q, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(s), pa.array(coarse)], ["query_id", "id", "score", "coarse"])

    hits = rows.mapInArrow(run, OUT)
    if oversample:
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("coarse", 9)), "id")
        hits = hits.withColumn("_c", F.row_number().over(w)).where(F.col("_c") <= k * oversample).drop("_c")
    if shards:
        w = Window.partitionBy("query_id", F.pmod("id", F.lit(shards))).orderBy(F.desc(F.round("score", 9)), "id")
        hits = hits.withColumn("_s", F.row_number().over(w)).where(F.col("_s") <= k).drop("_s")
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _cut(chunks: Iterator[tuple], rows: int) -> Iterator[tuple]:
    """The same in pieces of at most ``rows`` queries."""
    for chunk in chunks:
        for a in range(0, len(chunk[0]), rows):
            yield tuple(x[a : a + rows] for x in chunk)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ids, vectors`` of ``size`` rows; the last ones may be fewer."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while len(b):
            part = b.slice(0, size - sum(map(len, held)))
            held.append(part)
            b = b.slice(len(part))
            if sum(map(len, held)) == size:
                t = pa.Table.from_batches(held)
                held = []
                yield t.column(0).to_numpy(), matrix(t.column(1))
    if held:
        t = pa.Table.from_batches(held)
        yield t.column(0).to_numpy(), matrix(t.column(1))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


# -- inverted cells -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CellIndex:
    """Centres, and every vector stored under each of its nearest cells, in the order of cells."""

    centres: np.ndarray
    stored: DataFrame


def build_cells(vectors: DataFrame, cells: int = 128, spill: int = 2, sample: int = 16_384, rounds: int = 10, id_col: str = "vec_id", col: str = "embedding") -> CellIndex | None:
    """K-means centres from at most ``sample`` rows (smallest hash of the id); every row is stored with ``spill`` cells.

    A filter on the cell reads only row groups that hold it.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not got.num_rows:
        return None
    x = matrix(got.column("v"))
    centres = x[np.random.default_rng(5).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    sent, m = spark.sparkContext.broadcast(centres), min(spill, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = np.argsort(distances(matrix(b.column(1)), sent.value), axis=1, kind="stable")[:, :m].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(b)), m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel())], ["id", "v", "cell"])

    assigned = materialise(rows.mapInArrow(assign, "id long, v array<double>, cell int"), "assigned")
    return CellIndex(centres, materialise(assigned.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "cells"))


def search_cells(index: CellIndex | None, vectors: DataFrame, which: Column, k: int, probes: int = 32, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Approximate neighbours: exact scores within the ``probes`` nearest cells of each query."""
    spark = vectors.sparkSession
    stored = store_queries(vectors, which, id_col, col)
    if index is None or stored is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    sent = spark.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(2).to_numpy()
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            for qid, q in stored.chunks():
                near = np.argsort(distances(q, sent.value), axis=1, kind="stable")[:, :probes]
                for c in np.unique(cell):
                    asks, mine = np.flatnonzero((near == c).any(1)), np.flatnonzero(cell == c)
                    if len(asks):
                        r, at, s, _ = l2(q[asks], x[mine], k)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[asks[r]]), pa.array(ids[mine[at]]), pa.array(s)], ["query_id", "id", "score"])

    hits = index.stored.mapInArrow(run, "query_id long, id long, score double")
    return ranked(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


# -- late interaction -----------------------------------------------------------------------------------------------


def max_sim(tokens: DataFrame, query: np.ndarray, k: int, candidates: DataFrame | None = None, id_col: str = "id", col: str = "vec") -> DataFrame:
    """Late interaction over ``(id, vec)`` token rows: per query token the best match, at least 0, summed over the query.

    Tasks multiply whole batches and send, per document and task, one row of maxima. ``candidates(id)`` restricts the
    documents. The query is one text's tokens.
    """
    unit = _unit(np.asarray(query, np.float64))
    if candidates is not None:
        tokens = tokens.join(candidates.select(F.col(id_col)).distinct(), id_col, "left_semi")
    rows = tokens.where(F.col(col).isNotNull()).select(id_col, F.col(col).cast("array<double>").alias("v"))
    names = [f"q{i}" for i in range(len(unit))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            s = np.maximum(_unit(matrix(b.column(1))) @ unit.T, 0)
            coded = b.column(0).dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
            top = np.maximum.reduceat(s[order], head, axis=0)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at[order][head])), *(pa.array(c) for c in top.T)], [id_col, *names])

    schema = f"{id_col} {dict(tokens.dtypes)[id_col]}, " + ", ".join(f"{n} double" for n in names)
    best = rows.mapInArrow(run, schema).groupBy(id_col).agg(*[F.max(n).alias(n) for n in names])
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return best.select(id_col, total.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def store_vectors(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """A table ``vec_id, embedding`` of a small matrix, for tests and benchmarks."""
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))})
    return materialise(spark.createDataFrame(table).repartition(spark.sparkContext.defaultParallelism), "vectors")
