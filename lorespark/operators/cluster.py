"""What a replicated store does, as queries: placement, quorum, reconciliation, repair, rebalancing, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(id_: Column, nodes: int, replicas: int) -> Column:
    """The nodes of an id: its number modulo ``nodes`` and the ones after it."""
    return F.transform(F.sequence(F.lit(0), F.lit(replicas - 1)), lambda r: F.pmod(id_ + r, F.lit(nodes)).cast("int"))


def write_quorum(acks: DataFrame, needed: int, id_col: str = "id") -> DataFrame:
    """Ids that at least ``needed`` different nodes acknowledged."""
    return acks.where("ok").groupBy(id_col).agg(F.countDistinct("node").alias("acks")).where(F.col("acks") >= needed)


def reconcile(replicas: DataFrame, id_col: str = "id") -> DataFrame:
    """Last write wins; ties to the smaller node."""
    w = Window.partitionBy(id_col).orderBy(F.desc("updated_at"), "node")
    return replicas.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repairs(replicas: DataFrame, nodes: int, copies: int, id_col: str = "id") -> DataFrame:
    """``id, node``: owners whose copy is missing, older or different."""
    won = reconcile(replicas, id_col).select(id_col, F.col("updated_at").alias("_at"), F.col("content").alias("_content"))
    due = won.withColumn("node", F.explode(owners(F.col(id_col), nodes, copies)))
    have = replicas.select(id_col, "node", "updated_at", "content")
    j = due.join(have, [id_col, "node"], "left")
    return j.where(F.col("updated_at").isNull() | (F.col("updated_at") < F.col("_at")) | ~F.col("content").eqNullSafe(F.col("_content"))).select(id_col, "node")


def moves(replicas: DataFrame, nodes: int, copies: int, id_col: str = "id") -> DataFrame:
    """``id, node`` of copies on nodes that don't own them, where an owner holds a copy (the last one never goes)."""
    own = replicas.withColumn("_own", F.array_contains(owners(F.col(id_col), nodes, copies), F.col("node")))
    safe = own.groupBy(id_col).agg(F.max("_own").alias("_safe"))
    return own.where("not _own").join(safe.where("_safe"), id_col).select(id_col, "node")


def merge_aggregates(partials: DataFrame) -> DataFrame:
    """One row from per-shard rows ``n, total, low, high``; the mean follows from the sums."""
    return partials.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("mean", F.col("total") / F.col("n"))


def merge_scalars(sql: str, partials: list[list[tuple]]) -> list[str]:
    """Cells of one scalar query over all nodes from the cells that each node gave, printed as the gateway prints them.

    COUNT and SUM add up, MIN and MAX compare; AVG and GROUP BY can't be merged from results and are refused with
    ``ValueError``, as is anything else. Whole numbers are printed without a fraction; without any value: NULL.
    """
    import re

    if re.search(r"\bgroup\s+by\b", sql, re.I) or re.search(r"\bavg\s*\(", sql, re.I):
        raise ValueError("AVG and GROUP BY can't be merged from the results of nodes; use merge_aggregates over partial sums")
    kinds = [m[1].lower() for m in re.finditer(r"\b(count|sum|min|max)\s*\(", sql.split(" from ")[0] if " from " in sql else re.split(r"\bfrom\b", sql, flags=re.I)[0], re.I)]
    if not kinds or any(len(row) != len(kinds) for rows in partials for row in rows):
        raise ValueError("only COUNT, SUM, MIN and MAX can be merged")
    out = []
    for i, kind in enumerate(kinds):
        values = [float(row[i]) for rows in partials for row in rows if row[i] is not None]
        merged = (sum(values) if kind in ("count", "sum") else min(values) if kind == "min" else max(values)) if values else 0.0 if kind == "count" else None
        out.append("NULL" if merged is None else str(int(merged)) if merged == int(merged) else str(merged))
    return out
