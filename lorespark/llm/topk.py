"""Exact top-k by integer inner product over a pivot-distance index.

Vectors become ``floor(scale * x)``. One more coordinate, ``sqrt(M - |x|^2)`` with M the largest squared norm, turns the
largest inner product into the smallest distance: ``d(q, x)^2 = |q|^2 + M - 2 q.x``. Every vector is keyed by its nearest
pivot and its distance to it, and the index is stored in the order of that key, so a slab of neighbouring rows covers
few, narrow annuli (pivot, least and greatest distance). By the triangle inequality an annulus outside
``d(q, pivot) +- radius`` holds nothing better than the radius says and is skipped. The search goes in two rounds:

1. Each slab answers the queries that lie in it against its own rows; the k-th best score (or that among the sample)
   is the query's first radius.
2. Chunks of queries, stored in the order of the same key, meet every slab. A directory holds, per chunk, the range of
   its queries' distances to each pivot and the largest radius; a slab reads only chunks that may reach one of its
   annuli. Annuli are expanded nearest first, and the radius shrinks as better scores are found.

Pivots come from a sample of at most ``sample`` rows; every row is indexed and the result is exact whatever the sample.
Neither side is broadcast or collected: queries against all rows, block by block.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do those whose dimension
isn't the commonest one (ties to the larger); of several rows with one id that is a query, one with the least vector
asks, and the others are candidates like any row but the query's own; a null id is never a query, and as a candidate
comes last among equal scores; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.session import materialise, shared_path

SLAB = 65_536
CHUNK = 512
ANNULUS = 2048
SLACK = 1e-6


@dataclass(frozen=True)
class PivotIndex:
    """Pivots (with the added coordinate), the largest squared norm, and the sample that gives first radii."""

    pivots: np.ndarray
    norm: float
    sample_ids: np.ndarray
    sample: np.ndarray


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def quantised(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: integer components as doubles, taking part only if all are finite."""
    x = F.col(vector)
    ok = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))).alias("v")).where("v is not null")


def fit_index(vectors: DataFrame, pivots: int = 32, sample: int = 8192, rounds: int = 8) -> PivotIndex | None:
    """K-means on at most ``sample`` rows (smallest hash of the id) of the commonest dimension."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return None
    got = vectors.where(F.size("v") == dims.d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    ids, x = _ids(got.column("vec_id")), _matrix(got.column("v"), dims.d)
    y = lift(x, dims.norm)
    rng = np.random.default_rng(11)
    centres = y[rng.choice(len(y), min(pivots, len(y)), replace=False)]
    for _ in range(rounds):
        near = _distances(y, centres).argmin(1)
        centres = np.stack([y[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return PivotIndex(centres, float(dims.norm), ids, x)


LAST = np.iinfo(np.int64).max  # stands for a null id, which sorts last


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row; minus infinity where there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def _to_pivots(q: np.ndarray, index: PivotIndex) -> np.ndarray:
    """Distances of queries, whose added coordinate is 0, to the pivots."""
    return _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), index.pivots)


def store_index(vectors: DataFrame, index: PivotIndex, sent, slab: int) -> DataFrame:
    """``row, vec_id, v, pivot, d, asks``, stored in the order of (pivot, d): the clustered index."""
    dim = index.sample.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = sent.value
        for b in batches:
            if len(b):
                d = _distances(lift(_matrix(b.column(2), dim), idx.norm), idx.pivots)
                pivot = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], ["row", "vec_id", "v", "asks", "pivot", "d"])

    keyed = vectors.select("row", "vec_id", "v", "asks").mapInArrow(run, "row long, vec_id long, v array<double>, asks boolean, pivot int, d double")
    rows = vectors.count()
    # slabs bound a task's memory; a small table makes smaller ones, so that all cores have some
    n = max(1, -(-rows // slab), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows // ANNULUS)))
    return materialise(keyed.repartitionByRange(n, "pivot", "d").sortWithinPartitions("pivot", "d"), "topk-index")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, index: PivotIndex | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each row that ``queries`` holds for."""
    spark = vectors.sparkSession
    index = index or fit_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = index.sample.shape[1]
    sent = spark.sparkContext.broadcast(index)  # bounded: at most `sample` vectors
    # a number for each row, fixed by writing it down: ids may repeat
    rows = materialise(vectors.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce(queries & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")), "topk-rows")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("v", "row")).alias("m"), F.count(F.lit(1)).alias("n"))
    spare = asked.where("n > 1").select("vec_id", F.col("m.row").alias("_asks"))
    if spare.limit(1).count():  # only one row of a repeated query id asks
        rows = rows.join(spare.hint("shuffle_hash"), "vec_id", "left").withColumn("asks", F.col("asks") & (F.col("_asks").isNull() | (F.col("_asks") == F.col("row")))).drop("_asks")
    stored = store_index(rows, index, sent, SLAB)
    path = shared_path(spark, "topk-queries")

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        for b in itertools.chain(batches, [None]):
            if b is not None and len(b):
                held.append(b)
            if held and (b is None or sum(map(len, held)) >= SLAB):
                t = pa.Table.from_batches(held).combine_chunks()
                held = []
                x, pivot, d = _matrix(t.column("v"), dim), t.column("pivot").to_numpy(), t.column("d").to_numpy()
                o = np.lexsort([d, pivot])
                yield t.column("row").to_numpy()[o], _ids(t.column("vec_id"))[o], x[o], pivot[o], d[o], t.column("asks").to_numpy()[o]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write each slab's queries with their first scores, a chunk per record batch; report the chunks."""
        idx, task = sent.value, TaskContext.get()
        fs, root = _fs(path)
        name = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}.arrow"  # only files that finished tasks report are read
        schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64(), dim)), ("least", pa.float64())])
        out, writer, done = None, None, []
        for row, ids, x, _, _, asks in slabs(batches):
            at = np.flatnonzero(asks)
            for a in range(0, len(at), CHUNK):
                mine = at[a : a + CHUNK]
                q = x[mine]
                s = q @ idx.sample.T
                s[ids[mine][:, None] == idx.sample_ids[None]] = -np.inf  # sample rows have no numbers: leave the whole id out
                home = np.full((len(mine), k), -np.inf)
                for e in range(0, len(x), 4 * ANNULUS):
                    part = q @ x[e : e + 4 * ANNULUS].T
                    own = np.flatnonzero((mine >= e) & (mine < e + 4 * ANNULUS))
                    part[own, mine[own] - e] = -np.inf
                    home = np.partition(np.concatenate([home, part], axis=1), part.shape[1], axis=1)[:, part.shape[1] :]
                least, dq = np.maximum(_kth(s, k), home.min(1)), _to_pivots(q, idx)
                radius = np.sqrt(np.maximum((q * q).sum(1) + idx.norm - 2 * least, 0)).max()
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(name)
                    writer = pa.ipc.new_file(out, schema)
                writer.write_batch(pa.record_batch([pa.array(row[mine]), pa.array(ids[mine]), pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), dim), pa.array(least)], schema=schema))
                done.append((name, len(done), float(radius), dq.min(0).tolist(), dq.max(0).tolist()))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["name", "batch", "radius", "lo", "hi"])

    listed = f"{path}-list"
    stored.mapInArrow(first_round, "name string, batch long, radius double, lo array<double>, hi array<double>").write.parquet(listed)

    def directory() -> Iterator[pa.RecordBatch]:
        fs, root = _fs(listed)
        for info in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(batch_size=4096)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = sent.value
        for row, ids, x, pivot, d, _ in slabs(batches):
            cut = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
            blocks = [(a, min(a + ANNULUS, e)) for s, e in zip(cut, [*cut[1:], len(ids)]) for a in range(s, e, ANNULUS)]
            own = np.array([pivot[a] for a, _ in blocks])
            near, far = np.array([d[a] for a, _ in blocks]), np.array([d[e - 1] for _, e in blocks])
            for listing in directory():
                lo, hi = (np.stack(listing.column(c).to_numpy(zero_copy_only=False))[:, own] for c in ("lo", "hi"))
                gap = np.maximum(near[None] - hi, lo - far[None])  # no query of the chunk is closer to a row of the annulus
                reach = listing.column("radius").to_numpy() * (1 + SLACK) + SLACK
                for c in np.flatnonzero((gap <= reach[:, None]).any(1)):
                    yield from _expand(_chunk(listing.column("name")[int(c)].as_py(), listing.column("batch")[int(c)].as_py()), row, ids, x, blocks, own, near, far, idx)

    opened: dict[str, pa.ipc.RecordBatchFileReader] = {}

    def _chunk(name: str, batch: int) -> pa.RecordBatch:
        if name not in opened:
            opened.clear()
            opened[name] = pa.ipc.open_file(_fs(path)[0].open_input_file(name))
        return opened[name].get_batch(batch)

    def _expand(chunk: pa.RecordBatch, row, ids, x, blocks, own, near, far, idx) -> Iterator[pa.RecordBatch]:
        qrow, qid, q, least = chunk.column(0).to_numpy(), chunk.column(1).to_numpy(), _matrix(chunk.column(2), dim), chunk.column(3).to_numpy().copy()
        sq = (q * q).sum(1)
        dq = _to_pivots(q, idx)[:, own]
        gap = np.maximum(np.maximum(near[None] - dq, dq - far[None]), 0)
        found: list[list[np.ndarray]] = [[], [], []]
        for b in np.argsort(gap.mean(0), kind="stable"):
            radius = np.sqrt(np.maximum(sq + idx.norm - 2 * least, 0))
            need = np.flatnonzero(gap[:, b] <= radius * (1 + SLACK) + SLACK)
            if not len(need):
                continue
            a, e = blocks[b]
            s = q[need] @ x[a:e].T
            hit = s >= least[need, None]
            hit &= qrow[need, None] != row[None, a:e]
            r, c = np.nonzero(hit)
            found[0].append(need[r]), found[1].append(ids[a:e][c]), found[2].append(s[r, c])
            if e - a >= k:
                least[need] = np.maximum(least[need], _kth(np.where(hit, s, -np.inf), k))
        if found[0]:
            r, i, s = (np.concatenate(f) for f in found)
            o = np.lexsort([i, -s, r])
            r, i, s = r[o], i[o], s[o]
            o = np.arange(len(r)) - np.searchsorted(r, r) < k
            i = i[o]
            yield pa.RecordBatch.from_arrays([pa.array(qid[r[o]]), pa.array(i, mask=i == LAST), pa.array(s[o].astype(np.int64))], ["query_id", "vec_id", "score"])

    hits = stored.mapInArrow(second_round, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: 20 best candidates of each row whose id is divisible by 20, among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(materialise(quantised(rows, "embedding", 64), "topk-vectors"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v, rid) = 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM q JOIN v c ON q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
