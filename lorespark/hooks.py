"""Seams for models: embeddings, language models, cross-encoders. Nothing here calls a network; pass your own client."""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    """Texts to vectors of one length; has to be picklable, for it runs in the executors."""

    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class CrossEncoder(Protocol):
    """Joint scores of a question and each text, higher is better."""

    def score(self, question: str, texts: Sequence[str]) -> Sequence[float]: ...


class ProxyEmbeddings:
    """A bag of hashed words without a model: each word adds to five places with falling weights; unit length."""

    OFFSETS, WEIGHTS = np.array([0, 1, 7, 13, 29]), np.array([1.0, 0.5, 0.3, 0.2, 0.15])

    def __init__(self, dim: int = 128):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in re.split(r"[\W_]+", text.lower()) if w and len(w.encode()) <= 40], np.int64)
            at = ((h[:, None] + self.OFFSETS[None]) % self.dim).ravel()
            out[i] = np.bincount(at, np.tile(self.WEIGHTS, len(h)), minlength=self.dim)
        n = np.sqrt((out * out).sum(1))[:, None]
        return np.where(n > 0, out / np.where(n > 0, n, 1), 0.0)


class Retrying:
    """A provider that asks ``inner`` up to ``tries`` times, a little later each time, and remembers recent texts."""

    def __init__(self, inner: EmbeddingProvider, tries: int = 3, pause: float = 0.5, size: int = 10_000, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.tries, self.pause, self.size, self.sleep, self.dim = inner, tries, pause, size, sleep, inner.dim
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        known = {t: self.held[t] for t in texts if t in self.held}
        new = [t for t in dict.fromkeys(texts) if t not in known]
        for attempt in range(1, self.tries + 1 if new else 1):
            try:
                known |= dict(zip(new, self.inner.embed(new)))
                break
            except Exception:
                if attempt == self.tries:
                    raise
                self.sleep(self.pause * attempt)
        self.held.update((t, known[t]) for t in new)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return np.stack([known[t] for t in texts]) if texts else np.zeros((0, self.dim))


def embed_column(df: DataFrame, text: str, provider: EmbeddingProvider, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column, batch by batch in the executors; null of null."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.FloatType()))])
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            some = [t for t in texts if t is not None]
            vectors = iter(provider.embed(some).astype(np.float32).tolist() if some else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def reranker(encoder: CrossEncoder) -> Callable[[str, DataFrame], DataFrame]:
    """A second stage for ``ask``: joint scores replace the scores of the (at most k) results, by an Arrow UDF."""

    def rerank(question: str, loaded: DataFrame) -> DataFrame:
        @F.arrow_udf("double")
        def joint(texts: pa.Array) -> pa.Array:
            return pa.array([float(x) for x in encoder.score(question, texts.to_pylist())], pa.float64())

        return loaded.withColumn("score", joint("content"))

    return rerank


# -- what language models are asked ---------------------------------------------------------------------------------


def ask_or(model: LanguageModel | None, system: str, user: str) -> str | None:
    """The model's answer, stripped; None without a model, on failure, or for an empty answer."""
    if model is None:
        return None
    try:
        return model.complete(system, user).strip() or None
    except Exception:  # a model that fails must not fail the operation it decorates
        return None


def distil(model: LanguageModel | None, text: str) -> str | None:
    """The one fact of a turn that is worth keeping, or None; without a model the turn itself."""
    if model is None:
        return text
    said = ask_or(model, "Name the one lasting fact or preference in this message as a short statement. If there is none, answer NOOP.", text)
    return None if said is None or said.lower() == "noop" else said


def situate(model: LanguageModel | None, text: str) -> str:
    """A text with a sentence of context before it, for indexing only."""
    said = ask_or(model, "Write one sentence that says what this text is about, for a search index.", text)
    return f"{said}\n{text}" if said else text


def write_sql(model: LanguageModel | None, question: str, columns: str) -> str | None:
    return ask_or(model, f"Write one SELECT for a table knowledge({columns}). Answer with SQL only.", question)


def summarise(model: LanguageModel | None, texts: Sequence[str], length: int = 280) -> str:
    joined = "\n- ".join(texts)
    return ask_or(model, "Sum up these related items in one short paragraph.", joined) or f"Community of {len(texts)} items: {joined[:length]}"


def partial_answer(model: LanguageModel | None, question: str, summary: str) -> str | None:
    """What one summary says about a question, or None."""
    said = ask_or(model, "Answer the question from this summary alone, in part if need be. If it has no bearing, answer NONE.", f"{summary}\n\nQuestion: {question}")
    return None if said is None or said.lower() == "none" else said


def combine(model: LanguageModel | None, question: str, parts: Sequence[str]) -> str | None:
    """One answer out of partial ones; these alone if the model fails; None without any."""
    if not parts:
        return None
    return ask_or(model, "Combine these partial answers into one.", f"Question: {question}\n- " + "\n- ".join(parts)) or " ".join(parts)
