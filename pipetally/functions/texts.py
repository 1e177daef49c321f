"""Text functions of the tracked application's views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, an id and a date by shape.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def trimmed(s: Column) -> Column:
    """Without any white space at both ends (Spark's trim removes spaces only)."""
    return F.regexp_replace(s, r"^[\s ﻿]+|[\s ﻿]+$", "")


def or_else(s: Column, default: str) -> Column:
    """``default`` for null and for empty."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def initials(s: Column) -> Column:
    """First letters of the first two words, where @ parts words too."""
    words = F.filter(F.split(s, r"\s+|@"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def human_size(n: Column) -> Column:
    """Bytes with up to two decimals and a unit of powers of 1024; sizes from a terabyte on stay in GB."""
    scaled = (
        F.when(n < 1024, n.cast("double")).when(n < 1024**2, n / 1024).when(n < 1024**3, n / 1024**2).otherwise(n / 1024**3)
    )
    unit = F.when(n < 1024, "Bytes").when(n < 1024**2, "KB").when(n < 1024**3, "MB").otherwise("GB")
    digits = F.regexp_replace(F.format_string("%.2f", F.floor(scaled * 100 + 0.5) / 100), r"\.?0+$", "")
    return F.when(n.isNull() | (n == 0), "0 Bytes").otherwise(F.concat_ws(" ", digits, unit))


def shown_size(n: Column) -> Column:
    """What a list of files shows: a size that is missing, or none, is not known."""
    return F.when(n.isNull() | (n == 0), "Unknown size").otherwise(human_size(n))


def date_only(s: Column) -> Column:
    """The day of a ``yyyy-MM-dd`` text; null for anything else."""
    return F.when(s.rlike(DATE_ONLY), s.try_cast("date"))


def unbroken_base64(b: Column) -> Column:
    return F.regexp_replace(F.base64(b), "[\r\n]", "")


def role_at_company(position: Column, company: Column) -> Column:
    """``position at company``, or what there is of it."""
    at = F.when(F.coalesce(company, F.lit("")) != "", F.concat(position, F.lit(" at "), company)).otherwise(position)
    return F.when(F.coalesce(position, F.lit("")) != "", at).otherwise(company)
