"""Row numbers within groups of any size, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import materialise


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: the place, from 1, of each row in its group (of columns without nulls) by ``order``.

    Rows are cut into ranges of (group, order), so a group that holds most rows is spread over many tasks; each range
    is numbered for itself and shifted by the rows of the group's earlier ranges. Only the first group of a range can
    have earlier ranges, so there are at most as many shifts as ranges, and they come by broadcast.
    """
    # written down, so that the sampling for ranges computes nothing twice, and ranges and numbers can't disagree
    df = materialise(df, "unranked")
    ranged = materialise(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_before", F.sum("_rows").over(earlier)).where("_before > 0").drop("_rows")
    w = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = ranged.join(F.broadcast(shifts), [*group, "_range"], "left")
    return numbered.withColumn(out, F.row_number().over(w) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")
