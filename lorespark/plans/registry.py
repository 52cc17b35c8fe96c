"""Registered queries over the reference tables and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.plans import core_queries, sqlfront
from lorespark.plans.sql_surface import SURFACE, TABLES


def _surface(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql))
    return lambda spark, sf_dir: sqlfront.select_files(spark, sql, sf_dir, names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Statements of the SQL surface run as they are, but for one whose aggregates are planned apart."""
    return {**core_queries.QUERIES, **{name: _surface(sql) for name, (sql, _) in SURFACE.items()}, "agg_approx": core_queries.agg_approx}


def oracle_sql() -> dict[str, str]:
    return {**core_queries.SQL, **{name: other or sql for name, (sql, other) in SURFACE.items()}}
