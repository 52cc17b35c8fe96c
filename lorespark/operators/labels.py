"""Labels of numbered nodes, round by round: edges stay where they are stored, and only labels move.

Nodes are numbered from 0 in the order of their ids, so the smallest number is the smallest id. A round is one pass of
the stored edges in NumPy, a file per task; it leaves a table of new labels in the shared folder, which each Python
worker reads once. A worker holds one label per node (4 bytes below 2^31 nodes), whatever the number of edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.components import forest
from lorespark.operators.ranks import positions
from lorespark.operators.vector_batch import _fs
from lorespark.session import materialise, shared_path

PART = 1 << 20  # edges at a time


def numbered(edges: DataFrame) -> tuple[DataFrame, str, int]:
    """``nodes(id, n)``, the path of the edges between different nodes as ``a, b``, and how many nodes there are."""
    ends = materialise(edges.where("src <> dst").select("src", "dst"), "ends")
    ids = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).distinct()
    nodes = materialise(positions(ids, [], ["id"], "_n").select("id", (F.col("_n") - 1).cast("long").alias("n")), "nodes")
    # never by broadcast: short compressed ids look small, and are one per node
    b = ends.join(nodes.select(F.col("id").alias("dst"), F.col("n").alias("b")).hint("shuffle_hash"), "dst").select("src", "b")
    pairs = b.join(nodes.select(F.col("id").alias("src"), F.col("n").alias("a")).hint("shuffle_hash"), "src").select("a", "b")
    return nodes, store(pairs, "pairs"), nodes.count()


def named(labels: DataFrame, nodes: DataFrame, count: int, name: str) -> DataFrame:
    """``id`` and the id of the label of every row of ``labels(a, c)``, which should be a stored table."""
    size = labels.groupBy("c").agg(F.count(F.lit(1)).alias("_size"))
    names = nodes.select(F.col("n").alias("c"), F.col("id").alias(name))
    hot = size.where(F.col("_size") * 512 > count).select("c").join(names, "c")  # fewer than 512
    rows = labels.join(F.broadcast(hot), "c", "left")
    rest = rows.where(F.col(name).isNull()).select("a", "c").join(names.hint("shuffle_hash"), "c").select("a", name)
    return rows.where(F.col(name).isNotNull()).select("a", name).unionByName(rest).join(nodes.select(F.col("n").alias("a"), "id").hint("shuffle_hash"), "a").select("id", name)


def _parts(path: str) -> list[str]:
    """The files of a stored table."""
    fs, root = _fs(path)
    return sorted(i.path for i in fs.get_file_info(pa.fs.FileSelector(root)) if i.path.endswith(".parquet"))


def _read(path: str, file: str, rows: int = PART) -> Iterator[pa.RecordBatch]:
    with _fs(path)[0].open_input_file(file) as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=rows, use_threads=False)


def _files(path: str) -> Iterator[pa.RecordBatch]:
    for file in _parts(path):
        yield from _read(path, file)


def store(pairs: DataFrame, name: str) -> str:
    """The path of a stored table of numbers; ``over`` passes it, a file per task."""
    path = shared_path(pairs.sparkSession, name)
    pairs.write.parquet(path)
    return path


def over(spark: SparkSession, path: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over each file of ``store``, in the file's order."""
    files, rows = _parts(path), PART

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from run(_read(path, files[i], rows))

    return spark.range(0, len(files), 1, max(len(files), 1)).mapInArrow(each, schema)


#: The labels that this worker read last, by where they came from and the number of nodes.
_HELD: dict[tuple, np.ndarray] = {}


def _keep(key: tuple, labels: np.ndarray) -> np.ndarray:
    _HELD.clear()
    _HELD[key] = labels
    return labels


def _identity(count: int) -> np.ndarray:
    return np.arange(count, dtype=np.int32 if count < 1 << 31 else np.int64)


# -- votes ----------------------------------------------------------------------------------------------------------


def _winners(a: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of votes ``n`` for label ``c`` at ``a``, sorted by both: each ``a`` once and its commonest, then smallest label."""
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    seg = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(a))))
    best = np.flatnonzero(n == np.maximum.reduceat(n, head)[seg])
    first = best[np.concatenate([[True], seg[best][1:] != seg[best][:-1]])]
    return a[first], c[first]


def _tally(a: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same votes sorted by ``a, c`` and summed."""
    order = np.lexsort([c, a])
    a, c, n = a[order], c[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
    return a[head], c[head], np.add.reduceat(n, head)


def voted(path: str | None, count: int) -> np.ndarray:
    """Labels after the round that left ``path``: decided nodes, and votes of nodes that lie in several blocks."""
    if (path, count) in _HELD:
        return _HELD[path, count]
    labels, open_ = _identity(count), []
    if path is not None:
        _HELD.clear()
        for b in _files(path):
            a, c, n = (b.column(i).to_numpy() for i in range(3))
            done = n == 0
            labels[a[done]] = c[done]
            open_.append(np.stack([a[~done], c[~done], n[~done]]))
        if open_ and (votes := np.concatenate(open_, axis=1)).size:
            a, c = _winners(*_tally(*votes))
            labels[a] = c
    return _keep((path, count), labels)


def vote(spark: SparkSession, near: str, path: str | None, count: int) -> str:
    """One round over the stored ``a, b``, distinct and sorted by both: ``a, c, n, old`` with n = 0, or n of several votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = voted(path, count)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.cumsum(np.concatenate([[0], a[1:] != a[:-1]]))
            ids = a[np.concatenate([[True], a[1:] != a[:-1]])]
            key = at * count + labels[b]
            key.sort()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(head, len(key)))
            at, c = np.divmod(key[head], count)
            edge = (at == 0) | (at == len(ids) - 1)  # these nodes may go on in other batches or files
            w, wc = _winners(at[~edge], c[~edge], n[~edge]) if not edge.all() else (at[:0], c[:0])
            node = np.concatenate([ids[w], ids[at[edge]]])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([wc, c[edge]])), pa.array(np.concatenate([np.zeros(len(w), np.int64), n[edge]])), pa.array(labels[node].astype(np.int64))], ["a", "c", "n", "old"])

    out = shared_path(spark, "votes")
    over(spark, near, run, "a long, c long, n long, old long").write.parquet(out)
    return out


def decided(spark: SparkSession, path: str) -> DataFrame:
    """``a, c, old`` of every node after a round."""
    rows = spark.read.schema("a long, c long, n long, old long").parquet(path)
    votes = rows.where("n > 0").groupBy("a", "c").agg(F.sum("n").alias("n"), F.max("old").alias("old"))
    late = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("w"), F.max("old").alias("old")).select("a", F.col("w.c").alias("c"), "old")
    return rows.where("n = 0").select("a", "c", "old").unionByName(late)


# -- roots ----------------------------------------------------------------------------------------------------------


def rooted(paths: list[str], count: int) -> np.ndarray:
    """The root of every node after the hooks of each of ``paths``, in their order."""
    key, before = (*paths, count), (*paths[:-1], count)
    if key in _HELD:
        return _HELD[key]
    known = bool(paths) and before in _HELD
    root = _HELD.pop(before) if known else _identity(count)
    for path in paths[-1:] if known else paths:
        for b in _files(path):
            root[b.column(0).to_numpy()] = b.column(1).to_numpy()
        while True:
            new = root[root]
            if (new == root).all():
                break
            root = new
    return _keep(key, root)


def hook(spark: SparkSession, pairs: str, paths: list[str], count: int) -> DataFrame:
    """``a, b``: roots that an edge joins, each with the smallest root that a task found it to be joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = rooted(paths, count)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = root[batch.column(0).to_numpy()].astype(np.int64), root[batch.column(1).to_numpy()].astype(np.int64)
            key = np.unique((np.maximum(x, y) * count + np.minimum(x, y))[x != y])
            a, b = np.concatenate([a, key // count]), np.concatenate([b, key % count])
            if len(a) > PART:
                a, b = forest(a, b)
                if len(a) > PART // 2:  # mostly different nodes: hand them on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return over(spark, pairs, run, "a long, b long").groupBy("a").agg(F.min("b").alias("b"))


def labelled(nodes: DataFrame, paths: list[str], count: int) -> DataFrame:
    """``a, c``: every node and its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = rooted(paths, count)
        for b in batches:
            n = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(root[n].astype(np.int64))], ["a", "c"])

    return nodes.select("n").mapInArrow(run, "a long, c long")
