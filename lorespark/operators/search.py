"""Vector and full-text retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespark.functions import text as X
from lorespark.functions import vectors as V
from lorespark.operators import vector_batch as vb
from lorespark.operators.ranks import positions
from lorespark.session import materialise, shared_path

K1, B = 1.2, 0.75


def query_vector(vectors: DataFrame, id_: int, id_col: str = "vec_id", col: str = "embedding") -> list[float]:
    """The vector of one row."""
    return list(vectors.where(F.col(id_col) == id_).select(col).first()[0])


def top(scored: DataFrame, k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """Best scores, ties to the smaller id."""
    return scored.orderBy(F.desc(score), id_col).limit(k)


def knn(vectors: DataFrame, query: Sequence[float], k: int, score: Callable[[Column, Column], Column] = V.cosine, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Exact nearest neighbours: one scan, partial top-k per task, one merge."""
    return top(vectors.select(id_col, score(F.col(col), V.literal(query)).alias("score")), k, id_col)


def scatter_merge(results: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Results of several nodes: the best score per id, then the best ids."""
    return top(results.groupBy(id_col).agg(F.max("score").alias("score")), k, id_col)


def proxy_embedding(dims: int = 128) -> Callable[[Column], Column]:
    """A bag of hashed words (an array of longs): each adds to five places with falling weights; unit length."""
    offsets, weights = np.array([0, 1, 7, 13, 29]), np.array([1.0, 0.5, 0.3, 0.2, 0.15])

    @F.pandas_udf("array<double>")
    def embed(hashes: pd.Series) -> pd.Series:
        def one(h: np.ndarray) -> np.ndarray:
            at = ((np.asarray(h, np.int64)[:, None] + offsets[None]) % dims).ravel()
            v = np.bincount(at, np.tile(weights, len(h)), minlength=dims)
            n = np.sqrt((v * v).sum())
            return v / n if n else v

        return hashes.map(lambda h: one(h if h is not None else []))

    return embed


def occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def _idf(n: Column | float, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _part(idf: Column, tf: Column, length: Column, mean: Column | float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, terms: Sequence[str], k: int | None = 20, fields: Sequence[str] = ("content",), id_col: str = "id") -> DataFrame:
    """BM25 of the documents that hold a term; scores of several fields add up. One scan, without an index.

    Frequencies of the few query terms are counted inside the scan; only documents that hold a term are kept. Sizes and
    document frequencies of all documents are observed in the same pass, so no text is split twice.
    """
    terms = list(dict.fromkeys(terms))
    # tokens are a column of their own, so that each text is split once
    split = docs.select(id_col, *[X.tokens(F.col(name)).alias(f"_tok{f}") for f, name in enumerate(fields)])
    cols, stats, any_hit = [F.col(id_col)], [F.count(F.lit(1)).alias("n")], F.lit(False)
    for f in range(len(fields)):
        toks = F.col(f"_tok{f}")
        cols.append(F.size(toks).alias(f"_len{f}"))
        stats.append(F.avg(f"_len{f}").alias(f"avg{f}"))
        for t, term in enumerate(terms):
            cols.append(occurrences(toks, term).alias(f"_tf{f}_{t}"))
            stats.append(F.sum((F.col(f"_tf{f}_{t}") > 0).cast("long")).alias(f"df{f}_{t}"))
            any_hit = any_hit | (F.col(f"_tf{f}_{t}") > 0)
    seen = Observation()
    held = materialise(split.select(*cols).observe(seen, *stats).where(any_hit), "bm25")
    all_ = seen.get
    score = F.lit(0.0)
    for f in range(len(fields)):
        for t in range(len(terms)):
            tf = F.col(f"_tf{f}_{t}")
            part = _part(_idf(F.lit(all_["n"] or 0), F.lit(all_[f"df{f}_{t}"] or 0)), tf, F.col(f"_len{f}"), F.lit(all_[f"avg{f}"] or 1.0))
            score = score + F.when(tf > 0, part).otherwise(0.0)
    scored = held.select(id_col, score.alias("score"))
    return scored if k is None else top(scored, k, id_col)


def postings(docs: DataFrame, field: str = "content", id_col: str = "id") -> DataFrame:
    """``term, id, tf`` of one field."""
    return docs.select(id_col, F.explode(X.tokens(F.col(field))).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class TextIndex:
    """An inverted index: ``postings(term, field, id, tf, len)`` sorted by term, documents, and mean length per field."""

    postings: DataFrame
    docs: int
    mean: dict[str, float]


#: The fields of an object's index: its id, its content with metadata and keywords before it, keywords, metadata values.
def object_fields() -> dict[str, Column]:
    return {
        "id": F.col("id"),
        "content": X.contextualize(F.col("content"), F.col("metadata"), F.col("keywords")),
        "keywords": F.array_join("keywords", " "),
        "metadata": F.to_json("metadata"),
    }


def _counted(split: DataFrame, names: Sequence[str]) -> DataFrame:
    """``id, field, len, term, tf`` of each row of ``split(id, _tok0, ...)``, counted inside the scan.

    An empty term, which no text has, stands for the field itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
                for i, name in enumerate(names):
                    n = np.diff(batch.column(i + 1).offsets.to_numpy()).astype(np.int64)
                    coded = batch.column(i + 1).flatten().dictionary_encode()
                    words = max(len(coded.dictionary), 1)
                    at, tf = np.unique(np.repeat(np.arange(len(n)), n) * words + coded.indices.to_numpy(), return_counts=True)
                    row = np.concatenate([np.arange(len(n)), at // words])
                    term = pa.concat_arrays([pa.array([""] * len(n), pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(at % words))])
                    tf = np.concatenate([np.ones(len(n), np.int32), tf.astype(np.int32)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([name] * len(row), pa.string()), pa.array(n[row].astype(np.int32)), term, pa.array(tf)], ["id", "field", "len", "term", "tf"])

    return split.mapInArrow(run, f"id {dict(split.dtypes)['id']}, field string, len int, term string, tf int")


def text_sizes(docs: DataFrame, fields: Mapping[str, Column], id_col: str = "id") -> DataFrame:
    """``field, docs, mean``: the sizes that an index of the same fields has, without its postings."""
    split = docs.select(F.col(id_col).alias("id"), F.array(*[F.struct(F.lit(name).alias("field"), F.size(X.tokens(c)).alias("len")) for name, c in fields.items()]).alias("f"))
    return _sizes(split.select("id", F.explode("f").alias("f")).select("id", "f.field", "f.len"), fields)


def _sizes(rows: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    sizes = rows.groupBy("field", "id").agg(F.max("len").alias("len")).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    names = rows.sparkSession.createDataFrame([(name,) for name in fields], "field string")
    return names.join(F.broadcast(sizes), "field", "left").select("field", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def build_text_index(docs: DataFrame, fields: Mapping[str, Column], path: str, id_col: str = "id") -> TextIndex:
    """Tokenise once and store the index under ``path``: postings in ranges of terms, and a row of statistics per field."""
    split = docs.select(F.col(id_col).alias("id"), *[X.tokens(c).alias(f"_tok{i}") for i, c in enumerate(fields.values())])
    rows = materialise(_counted(split, list(fields)), "postings")  # the range shuffle samples its input, and the statistics read it too
    ranged = rows.where("term <> ''").repartitionByRange("term", "id")
    # rows of one id lie in one range, so repeated ids are added up without another shuffle
    ranged = ranged.groupBy("term", "field", "id").agg(F.sum("tf").cast("int").alias("tf"), F.max("len").alias("len"))
    ranged.sortWithinPartitions("term", "field", "id").write.mode("overwrite").parquet(f"{path}/postings")
    _sizes(rows.where("term = ''"), fields).coalesce(1).write.mode("overwrite").parquet(f"{path}/text_stats")
    return load_text_index(docs.sparkSession, path)


def load_text_index(spark: SparkSession, path: str) -> TextIndex:
    stats = spark.read.parquet(f"{path}/text_stats").collect()  # a row per field
    return TextIndex(spark.read.parquet(f"{path}/postings"), stats[0].docs if stats else 0, {r.field: r["mean"] for r in stats})


def _weighed(index: TextIndex, post: DataFrame, *keep: str) -> DataFrame:
    """``term, id, _p``: each posting's part of a score."""
    df = post.groupBy("term", "field").agg(F.count(F.lit(1)).alias("_df")).hint("shuffle_hash")
    mean = F.create_map(*[x for name, m in index.mean.items() for x in (F.lit(name), F.lit(m or 1.0))])
    return post.join(df, ["term", "field"]).select("term", "id", *keep, _part(_idf(F.lit(index.docs), F.col("_df")), F.col("tf"), F.col("len"), mean[F.col("field")]).alias("_p"))


def bm25_index(index: TextIndex, terms: Sequence[str], k: int | None = 20) -> DataFrame:
    """``id, score`` from the stored index; only row groups that may hold one of the terms are read."""
    post = index.postings.where(F.col("term").isin(list(dict.fromkeys(terms)) or [""]))
    scored = _weighed(index, post).groupBy("id").agg(F.sum("_p").alias("score"))
    return scored if k is None else top(scored, k)


#: Documents and query rows that meet at a time, and cells of a table of weights.
DOCS, ASKS, CELLS = 1024, 256, 1 << 22


def bm25_batch(queries: DataFrame, index: TextIndex, k: int, query_id: str = "query_id", parts: int | None = None) -> DataFrame:
    """Top ``k`` documents of every row of ``queries(query_id, term)`` from the stored index.

    Every query meets every document, so the pairs are never rows: tasks hold some documents' weights by term, add up
    the rows of each query's terms, read from the shared folder, and keep its best ``k``. ``parts`` is the number of
    tasks, by document (a task a core if not given).
    """
    spark = queries.sparkSession
    wanted = materialise(queries.where(F.col(query_id).isNotNull()).select(query_id, "term").distinct(), "wanted")
    terms = materialise(positions(wanted.select("term").distinct(), [], ["term"], "_t"), "wanted-terms")
    # ids of any kind are numbered; no side is broadcast, as short texts in small files become large in memory
    asks = materialise(positions(wanted.select(query_id).distinct(), [], [query_id], "_q"), "wanted-queries")
    coded = wanted.join(terms.hint("shuffle_hash"), "term").join(asks.hint("shuffle_hash"), query_id)
    path = shared_path(spark, "query-terms")
    coded.groupBy("_q").agg(F.sort_array(F.collect_list(F.col("_t").cast("int"))).alias("_t")).withColumn("_n", F.size("_t")).sortWithinPartitions("_n").select(F.col("_q").cast("long").alias("_q"), "_t").write.parquet(path)
    held = index.postings.join(terms.hint("shuffle_hash"), "term")
    weighed = _weighed(index, held, "_t")
    tasks = parts or spark.sparkContext.defaultParallelism
    kind = dict(weighed.dtypes)["id"]
    spread = weighed.select("id", F.col("_t").cast("int").alias("_t"), "_p").repartition(tasks, "id").sortWithinPartitions("id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for ids, doc, t, p in _documents(batches):
            used, at = np.unique(t, return_inverse=True)
            table = np.zeros((len(used) + 1, len(ids)))  # the last row stands for terms that no document here has
            np.add.at(table, (at, doc), p)
            for i, (q, first, flat) in enumerate(_asked(path)):
                col = np.minimum(np.searchsorted(used, flat), len(used) - 1)
                col = np.where(used[col] == flat, col, len(used))
                n = np.diff(first)
                score = np.zeros((len(q), len(ids)))
                for j in range(int(n.max())):
                    some = np.flatnonzero(n > j)
                    hit = some[col[first[some] + j] < len(used)]
                    score[hit] += table[col[first[hit] + j]]
                exact, score = score, np.round(score, 9)
                if i not in best:
                    best[i] = (np.full((len(q), k), -1.0), np.zeros((len(q), k)), np.full((len(q), k), None, object))
                top, true, who = best[i]
                r, c = np.nonzero((exact > 0) & (score >= top[:, -1:]))
                if len(r) > 4 * k * len(q):
                    m = min(k, score.shape[1])
                    least = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
                    r, c = np.nonzero((exact > 0) & (score >= np.maximum(least, top[:, -1])[:, None]))
                # documents come in the order of their ids, so earlier ones win ties; the sort is stable
                for row in np.unique(r):
                    mine = c[slice(*np.searchsorted(r, [row, row + 1]))]
                    s = np.concatenate([top[row], score[row, mine]])
                    w = np.concatenate([who[row], ids[mine]])
                    order = np.argsort(-s, kind="stable")[:k]
                    top[row], true[row], who[row] = s[order], np.concatenate([true[row], exact[row, mine]])[order], w[order]
        for i, (q, _, _) in enumerate(_asked(path) if best else ()):
            top, true, who = best[i]
            r, c = np.nonzero(top >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(who[r, c].tolist(), ids_type), pa.array(true[r, c])], ["_q", "id", "score"])

    ids_type = to_arrow_type(index.postings.schema["id"].dataType)
    hits = spread.mapInArrow(run, f"_q long, id {kind}, score double")
    w = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), "id")
    found = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.join(asks.hint("shuffle_hash"), "_q").select(query_id, "id", "score", "rank")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents at a time of rows ``id, t, p`` in the order of ids: their ids, and place, term and weight of each row."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None and not len(batch):
            continue
        held = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None]
        if not held:
            return
        rows = pa.concat_tables(held)
        ids = rows.column(0).to_numpy()
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if batch is not None and len(head) <= DOCS:
            rest = rows
            continue
        whole, cut = (len(head), len(rows)) if batch is None else (len(head) - 1, head[-1])
        rest, ends = rows.slice(cut), np.append(head, len(rows))
        t, p, a = rows.column(1).to_numpy(), rows.column(2).to_numpy(), 0
        while a < whole:
            b = min(a + DOCS, whole)
            while b > a + 1 and len(np.unique(t[ends[a] : ends[b]])) * (b - a) > CELLS:
                b = a + (b - a + 1) // 2
            z = slice(ends[a], ends[b])
            yield ids[head[a:b]].astype(object), np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), t[z], p[z]
            a = b


def _asked(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stored queries, some at a time, always the same ones together: numbers, where each one's terms begin, terms."""
    fs, root = vb._fs(path)
    for info in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=ASKS, use_threads=False):
                    first = b.column(1).offsets.to_numpy()
                    yield b.column(0).to_numpy(), first - first[0], b.column(1).flatten().to_numpy()
