"""Quality classifier: hashed word n-grams, follow-the-regularised-leader training, sparse dot-product scores.

Defined cases: a null text counts as empty; an empty text has no features and scores the bias alone; a null label is
no example; no examples at all give every text 0.5; repeated rows are each scored (and learnt) as often as they occur;
input columns named like an output column are replaced by it; a null id is no example and not held out. A text's score
depends on that text alone, not on its neighbours or the partitioning. The fit takes at most ``max_rows`` labelled rows, those
of the smallest hash of the id; scoring covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm import ftrl, kernels
from lorespark.session import spread

ORDERS = (1, 2)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int
    params: ftrl.FtrlParams = field(default_factory=ftrl.FtrlParams)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by five (a null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(table: pa.Table, column: str, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    buf, starts, lens = kernels.text_buffer(table.column(column))
    for i, j in kernels.steps(starts, lens):
        lo, hi = starts[i], starts[j - 1] + lens[j - 1]
        tokens, counts = kernels.token_hashes(buf[lo:hi], starts[i:j] - lo, lens[i:j])
        rows, cols = kernels.ngram_features(tokens, counts, ORDERS, bits)
        yield i, j, *kernels.unit_counts(rows, cols, j - i, bits)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, params: ftrl.FtrlParams = ftrl.FtrlParams()) -> QualityModel:
    """Train on at most ``max_rows`` labelled rows (hash order), never on held-out ids.

    The sample of ids is bounded by ``max_rows``, so it is broadcast and the texts aren't shuffled.
    """
    sample = (
        labels.where(F.col(label).isNotNull() & ~held_out())
        .select(F.col("doc_id"), (F.col(label).cast("double") > 0).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "y")
        .limit(max_rows)
    )
    bits = params.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in kernels.gather_batches(batches, "text"):
            ids, y = t.column("doc_id"), t.column("y")
            for i, j, r, c, v in _features(t, "text", bits):
                cut = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).combine_chunks(), y.slice(i, j - i).combine_chunks(), pa.ListArray.from_arrays(cut, pa.array(c, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(v, pa.float32()))],
                    ["doc_id", "y", "idx", "val"],
                )

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    schema = T.StructType([picked.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.FloatType()))])
    got = picked.mapInArrow(extract, schema).toArrow()
    ids = np.array([str(x) for x in got.column("doc_id").to_pylist()])
    y = got.column("y").to_numpy()
    idx, val = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    if not len(ids):
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits, params)
    cut = idx.offsets.to_numpy()
    flat, x = idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy().astype(np.float64)
    cut = cut - cut[0]
    order = np.lexsort([y, ids, np.array([hash_text(s) for s in ids])])
    rows = [(flat[cut[k] : cut[k + 1]], x[cut[k] : cut[k + 1]], float(y[k])) for k in order]
    weights, bias = ftrl.train(rows, params)
    return QualityModel(weights.astype(np.float32), bias, bits, params)


def hash_text(s: str) -> int:
    """A fixed shuffle key, so that the order of training doesn't follow that of the ids."""
    import zlib

    return zlib.crc32(b"order" + s.encode())


def score_quality(docs: DataFrame, model: QualityModel, out: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the probability ``out`` that a text's label is 1. No shuffle."""
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, bits = sent.value
        for t in kernels.gather_batches(batches, "text", 8 << 20):
            scores = np.full(len(t), 1 / (1 + np.exp(-bias)))
            for i, j, r, c, v in _features(t, "text", bits):
                scores[i:j] = ftrl.score(r, c, v, j - i, weights, bias)
            yield from t.append_column(out, pa.array(scores)).to_batches()

    return docs.mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document scored, learnt from the rows that aren't held out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
