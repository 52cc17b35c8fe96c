"""The ask pipeline: retrieve by plan, expand over the graph, fuse, boost, filter, load and pack a context."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import vectors as V
from lorespark.operators import fusion, graph, objects, search
from lorespark.plans import planner
from lorespark.session import materialise


@dataclass(frozen=True)
class Corpus:
    """Objects and what is derived from them; ``vectors(id, embedding)``, ``edges(src, dst, ...)`` and the index are optional."""

    objects: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    now: str = "2025-01-01 00:00:00"
    index: search.TextIndex | None = None


def words(text: str) -> tuple[str, ...]:
    """A question's terms, as the index has them."""
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w and len(w.encode()) <= 40)


def fulltext(corpus: Corpus, terms: Sequence[str], limit: int) -> DataFrame:
    """Best matches of the stored index, if there is one; else of one scan over the contents."""
    return search.bm25_index(corpus.index, terms, limit) if corpus.index is not None else search.bm25(corpus.objects, terms, limit)


def _hits(parts: Sequence[tuple[str, DataFrame]], first: int, corpus: Corpus) -> DataFrame:
    out = corpus.objects.select(F.lit(0).alias("step"), F.lit("").alias("source"), "id", F.lit(0.0).alias("score")).limit(0)
    for k, (source, df) in enumerate(parts, first):
        out = out.unionByName(df.select(F.lit(k).alias("step"), F.lit(source).alias("source"), "id", F.col("score").cast("double").alias("score")))
    return out


def retrieve(corpus: Corpus, plan: planner.Plan, query_vector: Sequence[float] | None) -> DataFrame:
    """``step, source, id, score`` of every step; steps on one source stay apart. Graph steps follow in ``expand``.

    Time and metadata steps have no limit and no score of their own: a time step ranks what exists by ``now`` from the
    oldest on, a metadata step by id.
    """
    q, parts = plan.question, []
    for s in plan.steps:
        if s.kind in ("vector", "code") and corpus.vectors is not None and query_vector is not None:
            parts.append(("vector", search.knn(corpus.vectors, query_vector, s.limit or 20, V.l2_score, "id", "embedding")))
        elif s.kind == "fulltext" and (q.keywords or words(q.text)):
            parts.append(("fulltext", fulltext(corpus, words(" ".join(q.keywords)) or words(q.text), s.limit or 20)))
        elif s.kind == "time" and q.dates:
            past = corpus.objects.where(F.col("created_at") <= F.lit(corpus.now).cast("timestamp"))
            parts.append(("time", past.select("id", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("score"))))
        elif s.kind == "metadata":
            parts += [("metadata", objects.with_metadata(corpus.objects, {k: v}).select("id", F.lit(1.0).alias("score"))) for k, v in q.filters.items()]
    return _hits(parts, 0, corpus)


def corrective(corpus: Corpus, q: planner.Question, query_vector: Sequence[float] | None, limit: int = 50) -> DataFrame:
    """The wider pass over the question as it stands, as further steps."""
    parts = [("fulltext", fulltext(corpus, words(q.text), limit))] if words(q.text) else []
    if corpus.vectors is not None and query_vector is not None:
        parts.append(("vector", search.knn(corpus.vectors, query_vector, limit, V.l2_score, "id", "embedding")))
    return _hits(parts, 1000, corpus)


def expand(corpus: Corpus, hits: DataFrame, q: planner.Question) -> DataFrame:
    """New nodes near the hits, a step of its own: depth 2 for named entities, else 1."""
    depth = 2 if q.intent == "entity_search" or q.entities else 1
    seeds = hits.select("id", F.lit(0).alias("depth")).distinct()
    near = graph.scored(graph.bidirectional(corpus.edges, seeds, depth)).join(seeds.select("id"), "id", "left_anti")
    return near.select(F.lit(999).alias("step"), F.lit("graph").alias("source"), "id", F.col("score").cast("double").alias("score"))


CONFIDENT = 0.35


def ranked(corpus: Corpus, question: str | planner.Plan, k: int = 10, query_vector: Sequence[float] | None = None, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """``id, score, sources, n_sources`` of the best ``k`` objects.

    Results that cover too little, or on which sources don't agree, are retrieved once more, wider, and all fused anew.
    """
    plan = question if isinstance(question, planner.Plan) else planner.plan(planner.analyse(question))
    weights = fusion.weights_for(plan.question.intent)
    hits = retrieve(corpus, plan, query_vector)
    if corpus.edges is not None:
        hits = materialise(hits, "hits")
        hits = hits.unionByName(expand(corpus, hits, plan.question))
    places = materialise(fusion.rank_hits(hits), "places")
    fused = materialise(fusion.fuse(places, weights), "fused")
    if fusion.retrieval_confidence(fused, k).first().confidence < CONFIDENT:
        fused = fusion.fuse(places.unionByName(fusion.rank_hits(corrective(corpus, plan.question, query_vector))), weights)
    if metadata:
        fused = fused.join(objects.with_metadata(corpus.objects, metadata).select("id"), "id", "left_semi")
    # boosts only raise the best 3 k, so the best k are among them
    return fusion.best(fusion.rank_signals(fusion.best(fused, 3 * k), corpus.objects, k, corpus.now), k)


def ask(
    corpus: Corpus, question: str | planner.Plan, k: int = 10, budget: int | None = None, query_vector: Sequence[float] | None = None, metadata: Mapping[str, str] | None = None, rerank: Callable[[str, DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Ranked objects with contents; with a ``budget``, only the chunks of the packed context."""
    k = max(1, min(k, 100))
    spark = corpus.objects.sparkSession
    plan = question if isinstance(question, planner.Plan) else planner.plan(planner.analyse(question))
    best = ranked(corpus, plan, k, query_vector, metadata)
    rows = best.collect()  # at most k rows: the pipeline runs once, and the contents are fetched by id
    found = corpus.objects.where(F.col("id").isin([r.id for r in rows]))
    loaded = objects.load_results(spark.createDataFrame(rows, best.schema), found)
    if rerank is not None:
        loaded = rerank(plan.question.text, loaded)
    if budget is None:
        return loaded.orderBy(F.desc("score"), "id")
    return fusion.context(fusion.drop_similar(loaded), budget)
