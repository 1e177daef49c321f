"""Number functions with the rounding and guards of the tracked dashboards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def pct_change(cur: Column, prev: Column) -> Column:
    """Percent from ``prev`` to ``cur``; from nothing, 100 if there is something now, else 0."""
    return F.when(prev > 0, js_round((cur - prev) / prev * 100)).when(cur > 0, F.lit(100)).otherwise(F.lit(0)).cast("bigint")


def ratio_pct(part: Column, whole: Column) -> Column:
    """A rounded percentage, 0 of nothing."""
    return F.when(whole > 0, js_round(part / whole * 100)).otherwise(F.lit(0)).cast("bigint")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def pages_of(total: Column, limit: int) -> Column:
    return F.ceil(total / F.lit(limit)).cast("bigint")


def leading_int(s: Column) -> Column:
    """The integer a text starts with; null if there is none."""
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")


def normalised(values: Column, height: float = 32.0) -> Column:
    """An array drawn from ``height`` (its least value) up to 0 (its greatest); all equal: ``height``."""
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    step = F.when(span == 0, F.lit(1)).otherwise(span)
    return F.transform(values, lambda v: F.lit(height) - (v - low) / step * F.lit(height))
