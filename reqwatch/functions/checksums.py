"""Checksums of found numbers, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.  Multiplication of the dihedral group of order ten, and its position permutations.
_TIMES = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
          [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
_TURN = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
         [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """At least twelve digits whose mod-10 sum is right."""
    digits = _digits(value)
    return (F.length(digits) >= 12) & F.call_function("luhn_check", digits)


def verhoeff(value: Column) -> Column:
    """At least one digit, and a dihedral checksum of zero."""
    digits = F.reverse(_digits(value))
    flat = lambda rows: F.array(*(F.lit(x) for row in rows for x in row))
    places = F.filter(F.split(digits, ""), lambda c: c != "")
    coded = F.transform(places, lambda c, k: F.struct(c.cast("int").alias("d"), (k % 8).alias("k")))
    turned = F.transform(coded, lambda x: F.get(flat(_TURN), x["k"] * 10 + x["d"]))
    return (F.length(digits) > 0) & (F.aggregate(turned, F.lit(0), lambda c, x: F.get(flat(_TIMES), c * 10 + x)) == 0)


VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn, "verhoeff": verhoeff}


def passes(name: str | None, value: Column, expression: str) -> Column:
    """Whether any full match in value passes the named check; an unknown name lets all pass."""
    check = VALIDATORS.get(name or "")
    return F.lit(True) if check is None else F.exists(F.regexp_extract_all(value, F.lit(expression), F.lit(0)), check)
