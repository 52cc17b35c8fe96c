"""Structured Streaming: ingest into the store and its derived tables, event windows, sessions, last write wins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from lorespark.functions import text as X


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with ``late``, a watermark lets finished windows leave the state."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity sessions per user."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark: repeated deliveries change nothing."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_writes(updates: DataFrame) -> DataFrame:
    """The latest content per id, for update mode."""
    return updates.groupBy("id").agg(F.max_by("content", "updated_at").alias("content"), F.max("updated_at").alias("updated_at"))


def ingest(objects: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append every micro-batch to ``objects``, ``postings`` and ``entities`` under ``out``.

    Each batch is written under its own number, so a batch that runs again replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/objects/batch={number}")
        batch.select("id", F.explode(X.tokens(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        batch.select("id", F.explode(X.entities(F.col("content"))).alias("entity")).write.mode("overwrite").parquet(f"{out}/entities/batch={number}")

    return _start(objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), interval)


def _start(writer, interval: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


LINKS = "src string, dst string, rel string, weight double"


def co_mentions(mentions: DataFrame, last: int = 5) -> DataFrame:
    """A stream ``entity, id, at`` to links between an object and the ``last`` earlier ones with the same entity.

    The state of an entity is its latest ``last`` ids, however many objects mention it. Rows of a micro-batch are
    taken in the order of (at, id); both directions are put out. A repeated id makes no link to itself.
    """
    def step(key: tuple, frames, state):
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        past = list(state.get[0]) if state.exists else []
        pairs = []
        for x in rows["id"]:
            pairs += [(x, p) for p in past if p != x]
            past = [*past, x][-last:]
        state.update((past,))
        both = [(a, b, "co_mentions", 0.5) for x, p in pairs for a, b in ((x, p), (p, x))]
        yield pd.DataFrame(both, columns=["src", "dst", "rel", "weight"])

    return mentions.where("entity is not null").groupBy("entity").applyInPandasWithState(step, LINKS, "past array<string>", "append", GroupStateTimeout.NoTimeout)


def stored_links(mentions: DataFrame, out: str, checkpoint: str, last: int = 5, interval: str | None = None) -> StreamingQuery:
    """``co_mentions`` of a stream, appended to a table."""
    return _start(co_mentions(mentions, last).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"), interval)
