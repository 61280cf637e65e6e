"""Confidence of a request's matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def attack_tool(user_agent: Column) -> Column:
    low, hit = F.lower(F.coalesce(user_agent, F.lit(""))), F.lit(False)
    for tool in fixed.ATTACK_TOOLS:
        hit = hit | low.contains(tool)
    return hit


def score(matches: Column, any_high: Column, any_weight: Column, tool: Column, mode_bonus: int = 0) -> Column:
    """0 without matches, else 20, 15 for each of up to three more, 15 for a high one, 10 for a weighty context, 25 for
    an attack tool and the mode's bonus, within 0 to 100."""
    total = 20 + 15 * F.least(matches - 1, F.lit(3)) + F.when(any_high, 15).otherwise(0) + F.when(any_weight, 10).otherwise(0) + F.when(tool, 25).otherwise(0) + mode_bonus
    return F.when(matches <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")


def score_label(value: Column) -> Column:
    return F.when(value >= 76, "very_high").when(value >= 51, "high").when(value >= 26, "medium").otherwise("low")
