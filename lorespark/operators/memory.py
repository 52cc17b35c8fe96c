"""Conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as X


def recent_turns(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of every session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def turn_count(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("count_so_far", F.count(F.lit(1)).over(w))


def promote(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """Turns worth keeping as objects: not the system's, not blank, one per session and content."""
    kept = turns.where((F.col("role") != "system") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    keyed = kept.withColumn("id", X.stable_id(F.col(session).cast("string"), F.col("text")))
    w = Window.partitionBy("id").orderBy("turn")
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
