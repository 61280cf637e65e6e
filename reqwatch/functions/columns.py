"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    """value as a literal of Spark SQL.  Large expressions are said in SQL: one parse instead of thousands of calls."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
