"""Rounding, defaulting and lookups in literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE operations in any engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_even(x: Column) -> Column:
    """To the nearest integer, ties to even, as a long."""
    return F.bround(x, 0).cast("long")


def falsy(x: Column) -> Column:
    """Zero counts as missing."""
    return F.when(x == 0, None).otherwise(x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def at_least(low, x: Column) -> Column:
    """x, but not under low; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), x))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a literal table, a chain of comparisons that needs no join."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out



def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def any_substring(text: Column, parts: tuple[str, ...]) -> Column:
    return _any(text, parts)


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole with at least 1 in the denominator, to one digit."""
    return round_half_up(100.0 * part / F.greatest(F.lit(1), whole), 1)
