"""Ranking and cost formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(created_at: Column, now: Column, e_folding_days: float = 30.0) -> Column:
    """``exp(-days / 30)`` over whole elapsed days, never negative."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created_at)) / 86400)
    return F.exp(-F.greatest(days, F.lit(0)) / e_folding_days)


def clamp_importance(x: Column) -> Column:
    """0 to 1; null counts as 0.5."""
    return F.least(F.greatest(F.coalesce(x.cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def boosted(score: Column, importance: Column, recency_: Column) -> Column:
    return score * (1 + 0.5 * importance) * (1 + 0.2 * recency_)


#: Price per thousand embedding calls, input tokens and output tokens; lookups are free.
EMBED, INPUT, OUTPUT = 2e-5, 1.5e-4, 6e-4


def cost(embed_calls: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return embed_calls / 1000 * EMBED + input_tokens / 1000 * INPUT + output_tokens / 1000 * OUTPUT
