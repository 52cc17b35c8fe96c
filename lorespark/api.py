"""One object with the engine's calls: insert, get, update, forget, search, ask, sql, remember, sessions, stats."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark import hooks
from lorespark.functions import text as X
from lorespark.metrics import CostTracker, Metrics
from lorespark.operators import graph, memory, objects, search
from lorespark.plans import ask as ask_plan
from lorespark.plans import planner, sqlfront
from lorespark.session import materialise, ship
from lorespark.sources.store import ObjectStore

MOST_ROWS = 10_000
ROLES = ("user", "assistant", "system", "observation")
TURNS = "conv_id string, at timestamp, uid string, role string, text string"


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


class Lorespark:
    """A store under ``path`` and everything that reads it. Writes append; every read sees the latest versions.

    A write also appends to the derived tables (postings of the contextualised text, entities, relationships, vectors),
    from which ``ask`` reads. ``provider`` embeds texts that come without a vector, and questions; ``llm`` is used for
    distillation, SQL, summaries and global answers where it is given; ``encoder`` scores the results of ``ask`` anew.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "default", provider: hooks.EmbeddingProvider | None = None, llm: hooks.LanguageModel | None = None, encoder: hooks.CrossEncoder | None = None):
        self.spark, self.path, self.model = ship(spark), path.rstrip("/"), model
        self.provider, self.llm, self.encoder = provider, llm, encoder
        self.store = ObjectStore(spark, f"{self.path}/objects")
        self.plans, self.metrics, self.costs = planner.PlanCache(), Metrics(), CostTracker()
        self._held: dict[str, object] = {}

    def _changed(self) -> None:
        self.plans.clear()
        self._held.clear()

    def _once(self, name: str, make: Callable[[], object]) -> object:
        """What was derived since the last write, computed once."""
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    # -- writing ----------------------------------------------------------------------------------------------------

    def write(self, batch: DataFrame) -> None:
        """Append a batch of any size with the object schema, and what follows from it; missing columns are filled in."""
        with self.metrics.timed("insert"):
            names, now = set(batch.columns), F.lit(_now()).cast("timestamp")
            content = F.col("content")
            fill = {
                "id": F.col("id") if "id" in names else X.stable_id(content),
                "importance": objects.clamp_importance(F.col("importance") if "importance" in names else F.lit(None)),
                "created_at": F.coalesce("created_at", now) if "created_at" in names else now,
                "updated_at": F.coalesce("updated_at", now) if "updated_at" in names else now,
            }
            cols = []
            for f in self.spark.createDataFrame([], objects.SCHEMA).schema:
                kind = f.dataType.typeName()
                empty = F.array() if kind == "array" else F.create_map() if kind == "map" else F.lit(None)
                value = fill.get(f.name, F.coalesce(F.col(f.name).cast(f.dataType), empty.cast(f.dataType)) if f.name in names else empty)
                cols.append(value.cast(f.dataType).alias(f.name))
            self._put(batch.select(*cols))

    def _put(self, full: DataFrame) -> None:
        if self.provider is not None:
            known = F.map_contains_key("embeddings", F.lit(self.model))
            text = F.when(~F.coalesce(known, F.lit(False)), X.contextualize(F.col("content"), F.col("metadata"), F.col("keywords")))
            made = hooks.embed_column(full.withColumn("_text", text), "_text", self.provider, "_vector")
            merged = F.when(F.col("_vector").isNull(), F.col("embeddings")).otherwise(F.map_concat(F.coalesce("embeddings", F.create_map().cast("map<string,array<float>>")), F.create_map(F.lit(self.model), F.col("_vector"))))
            full = made.withColumn("embeddings", merged).select(*full.columns)
        full = materialise(full, "batch")  # versions and derived rows come from one and the same batch
        self.store.put(full)
        self.store.fan_out(full)
        self._changed()

    def batch_insert(self, rows: Sequence[Mapping]) -> list[str]:
        """Insert up to 10 000 rows given as mappings; returns their ids in order."""
        if len(rows) > MOST_ROWS:
            raise ValueError(f"at most {MOST_ROWS} objects at once; write() takes a DataFrame of any size")
        full = [{**r, "id": r.get("id") or str(uuid.uuid4())} for r in rows]
        if full:
            allowed = self.spark.createDataFrame([], objects.SCHEMA).schema
            given = [f for f in allowed if any(f.name in r for r in full)]
            self.write(self.spark.createDataFrame([tuple(r.get(f.name) for f in given) for r in full], type(allowed)(given)))
        return [r["id"] for r in full]

    def insert(self, content: str, **fields) -> str:
        return self.batch_insert([{"content": content, **fields}])[0]

    remember = insert

    def update(self, id_: str, content: str | None = None, metadata: Mapping[str, str] | None = None, keywords: Sequence[str] | None = None, importance: float | None = None, description: str | None = None) -> int | None:
        """Append a changed version; returns how many versions are recorded, or None for an unknown id."""
        one = objects.get(self.objects(), id_)
        change = self.spark.createDataFrame([(id_, content, dict(metadata) if metadata else None, list(keywords or []), importance, description)], "id string, content string, metadata map<string,string>, keywords array<string>, importance double, description string")
        new = materialise(objects.update(one, change.withColumn("updated_at", F.lit(_now()).cast("timestamp"))), "update")
        found = new.select(F.size("version_history")).first()
        if found:
            self._put(new)
        return found[0] if found else None

    def forget(self, id_: str) -> bool:
        existed = objects.get(self._safe_objects(), id_).limit(1).count() > 0
        if existed:
            self.store.delete(self.spark.createDataFrame([(id_,)], "id string"), _now())
            self._changed()
        return existed

    def rebuild(self) -> None:
        """Compute the derived tables anew, for instance after many updates."""
        self.store.rebuild()
        self._changed()

    # -- reading ----------------------------------------------------------------------------------------------------

    def objects(self) -> DataFrame:
        return self.store.read()

    def get(self, id_: str) -> DataFrame:
        return objects.get(self.objects(), id_)

    def list(self, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
        now = self.list_ids()
        return objects.page(now, offset, limit), now.count()

    def list_ids(self) -> DataFrame:
        return self.objects().select("id")

    def count(self) -> int:
        return self.objects().count()

    def edges(self) -> DataFrame:
        """Explicit relationships and co-mentions of entities, stored once between two writes."""
        return self._once("edges", lambda: materialise(graph.add_edges(self.store.derived("edges"), graph.co_mentions(self.store.derived("entities"), "created_at")), "edges"))

    def text_index(self) -> search.TextIndex:
        return self._once("text", self.store.text_index)

    def vectors(self) -> DataFrame:
        return self.store.derived("vectors").where(F.col("model") == self.model).select("id", "embedding")

    def corpus(self) -> ask_plan.Corpus:
        return ask_plan.Corpus(self.objects(), self.vectors(), self.edges(), _now(), self.text_index())

    def ask(self, question: str, k: int = 10, budget: int | None = None, metadata: Mapping[str, str] | None = None, query_vector: Sequence[float] | None = None) -> DataFrame:
        """Ranked objects with contents, or the packed context within ``budget``; the plan comes out of the cache."""
        with self.metrics.timed("ask"):
            if query_vector is None and self.provider is not None:
                query_vector = self.provider.embed([question])[0].tolist()
                self.costs.record(embed_calls=1)
            plan = self.plans.get(question)
            rerank = hooks.reranker(self.encoder) if self.encoder is not None else None
            found = materialise(ask_plan.ask(self.corpus(), plan, k, budget, query_vector, metadata, rerank), "asked")
            self.costs.record(input_tokens=int(found.agg(F.sum(X.token_estimate(F.col("content")))).first()[0] or 0), lookups=len(plan.steps))
            return found

    def search(self, question: str, k: int = 10, metadata: Mapping[str, str] | None = None) -> DataFrame:
        return self.ask(question, k, None, metadata)

    def explain(self, question: str) -> str:
        return self.plans.get(question).explain()

    def sql(self, query: str) -> DataFrame:
        """Read-only SQL over the views ``knowledge`` and ``objects``."""
        with self.metrics.timed("sql"):
            now = self.objects()
            return sqlfront.select(self.spark, query, {"knowledge": now, "objects": now})

    def answer_with_sql(self, question: str) -> DataFrame | None:
        """Rows of the SELECT that the language model writes for a question; None without a model or a usable query."""
        query = hooks.write_sql(self.llm, question, ", ".join(f"{n} {t}" for n, t in self.objects().dtypes))
        if query is None:
            return None
        return self.sql(query) if sqlfront.is_read_only(self.spark, query, ["knowledge", "objects"]) else None

    def top_terms(self, terms: Sequence[str], k: int = 20) -> DataFrame:
        return search.bm25_index(self.text_index(), terms, k)

    # -- communities ------------------------------------------------------------------------------------------------

    def communities(self) -> DataFrame:
        """``community, members, summary`` of every community of two and more, stored once between two writes."""

        def make() -> DataFrame:
            found, llm = graph.summaries(graph.communities(self.edges()), self.objects()), self.llm
            if llm is not None:

                @F.arrow_udf("string")
                def written(text: pa.Array) -> pa.Array:
                    return pa.array([hooks.summarise(llm, [t]) for t in text.to_pylist()], pa.string())

                found = found.withColumn("summary", written("summary"))
            return materialise(found, "communities")

        return self._once("communities", make)

    def global_query(self, question: str) -> str | None:
        """An answer out of the summaries of all communities; None without a language model or a community that helps.

        Partial answers are asked for where the summaries are, in the executors; only those that say something come
        back, and they are combined.
        """
        if self.llm is None:
            return None
        llm = self.llm

        def ask_each(batches):
            for b in batches:
                said = [hooks.partial_answer(llm, question, s) for s in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([s for s in said if s], pa.string())], ["part"])

        parts = [r.part for r in self.communities().select("summary").mapInArrow(ask_each, "part string").collect()]  # an answer per community that has one
        return hooks.combine(llm, question, parts)

    # -- conversations ----------------------------------------------------------------------------------------------

    def record_turn(self, session: str, role: str, content: str) -> str | None:
        """Append a turn; one worth keeping also becomes an object that mentions what it is about.

        Turns are numbered by time when they are read, so turns recorded at once don't clash. An object is made once per
        session and content; with a language model it holds the fact that the model distils, if any.
        """
        role = role.lower() if role.lower() in ROLES else "user"
        turn = self.spark.createDataFrame([(session, str(uuid.uuid4()), role, content)], "conv_id string, uid string, role string, text string").withColumn("at", F.lit(_now()).cast("timestamp"))
        turn.select(*[c.split(" ")[0] for c in TURNS.split(", ")]).write.mode("append").parquet(f"{self.path}/turns")
        if role == "system" or not content.strip():
            return None
        fact = hooks.distil(self.llm, content)
        if fact is None:
            return None
        id_ = self.spark.range(1).select(X.stable_id(F.lit(session), F.lit(fact)).alias("id")).first().id
        if not objects.get(self._safe_objects(), id_).limit(1).count():
            about = [r.id for r in self.top_terms(ask_plan.words(fact), 3).collect()] if self._exists() else []
            self.batch_insert([{"id": id_, "content": fact, "metadata": {"session_id": session, "role": role, "kind": "memory"}, "relationships": [("mentions", t, None) for t in about]}])
        return id_

    def _exists(self) -> bool:
        return bool(self._safe_objects().limit(1).count())

    def _read_or_empty(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _safe_objects(self) -> DataFrame:
        try:
            return self.objects()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], objects.SCHEMA)

    def all_turns(self) -> DataFrame:
        """``conv_id, turn, role, text, at`` of all sessions that weren't deleted, turns numbered from 0."""
        gone = self._read_or_empty("sessions_deleted", "conv_id string, deleted_at timestamp").groupBy("conv_id").agg(F.max("deleted_at").alias("deleted_at"))
        live = self._read_or_empty("turns", TURNS).join(gone, "conv_id", "left").where("deleted_at is null or at > deleted_at").drop("deleted_at")
        return live.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "uid")) - 1).drop("uid")

    def turns(self, session: str) -> DataFrame:
        return self.all_turns().where(F.col("conv_id") == session)

    def get_session(self, session: str, last: int = 20) -> DataFrame:
        return memory.recent_turns(self.turns(session), last).orderBy("turn")

    def sessions(self) -> DataFrame:
        """``conv_id, turns, created, last_active``."""
        return self.all_turns().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("at").alias("created"), F.max("at").alias("last_active"))

    def delete_session(self, session: str) -> None:
        self.spark.createDataFrame([(session,)], "conv_id string").withColumn("deleted_at", F.lit(_now()).cast("timestamp")).write.mode("append").parquet(f"{self.path}/sessions_deleted")

    def set_fact(self, session: str, key: str, value: str) -> None:
        self.spark.createDataFrame([(session, key, value)], "conv_id string, key string, value string").withColumn("updated_at", F.lit(_now()).cast("timestamp")).write.mode("append").parquet(f"{self.path}/facts")

    def facts(self, session: str) -> dict[str, str]:
        """The session's working memory: the latest value of each key."""
        rows = self._read_or_empty("facts", "conv_id string, key string, value string, updated_at timestamp").where(F.col("conv_id") == session)
        return {r.key: r.value for r in rows.groupBy("key").agg(F.max_by("value", "updated_at").alias("value")).collect()}

    def pin(self, session: str, id_: str) -> None:
        self.spark.createDataFrame([(session, id_)], "conv_id string, id string").write.mode("append").parquet(f"{self.path}/pins")

    def pinned(self, session: str) -> DataFrame:
        pins = self._read_or_empty("pins", "conv_id string, id string").where(F.col("conv_id") == session).select("id").distinct()
        return self._safe_objects().join(pins, "id", "left_semi")

    # -- numbers ----------------------------------------------------------------------------------------------------

    def stats(self) -> dict[str, float]:
        """Objects, vectors, graph nodes and edges, sessions, cache hits and misses, and cost in dollars."""
        links = graph.counts(self.edges()).first()
        return {
            "objects": self.count(), "vectors": self.vectors().count(), "graph_nodes": links.nodes, "graph_edges": links.edges, "sessions": self.sessions().count(),
            "plan_cache_hits": self.plans.hits, "plan_cache_misses": self.plans.misses, "cost_usd": self.costs.total,
        }
