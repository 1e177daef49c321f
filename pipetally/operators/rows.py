"""Scans, filters, search, order and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.functions.numbers import pages_of


def select_rows(df: DataFrame, cols: Sequence[str | Column] = ("*",), where: Sequence[Column] = (), order: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """The builder chain select / filter / order / range over one table."""
    for w in where:
        df = df.filter(w)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*cols)


def equal_if(column: str, value: object) -> list[Column]:
    """An equality that applies only when a value is given."""
    return [F.col(column) == F.lit(value)] if value not in (None, "") else []


def exact_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def one_row(df: DataFrame, required: bool = True) -> DataFrame:
    """The one row of ``df``; more than one is an error, and so is none if ``required``."""
    top = df.limit(2)
    n = F.count("*").over(W.partitionBy(F.lit(1)))  # two rows at most
    rows = top.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row")).cast("boolean")).otherwise(F.lit(True)))
    if required:
        found = top.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no row")).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
        rows = rows.join(F.broadcast(found), F.lit(True), "right").filter("__ok").drop("__ok")
    return rows.drop("__n")


def search(df: DataFrame, cols: Sequence[str], needle: str, literal: bool = False) -> DataFrame:
    """Rows with ``needle`` in any of ``cols``, whatever the case; unless ``literal``, % and _ are wildcards. An empty needle matches all."""
    if needle == "":
        return df
    hit = F.lit(False)
    for c in cols:
        text = F.coalesce(F.col(c), F.lit(""))
        hit = hit | (F.contains(F.lower(text), F.lower(F.lit(needle))) if literal else F.col(c).ilike(f"%{needle}%"))
    return df.filter(hit)


def page(df: DataFrame, number: int, limit: int | str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """A page of ``df`` and its one-row envelope (page, limit, total, total_pages); limit 0 or ``all``: everything."""
    if isinstance(limit, str) and limit != "all" and not limit.lstrip("+-").isdigit():
        raise ValueError(f"limit: {limit}")
    size = 0 if limit == "all" else int(limit)
    rows = select_rows(df, order=order, limit=size or None, offset=(number - 1) * size)
    total = df.agg(F.count("*").alias("total"))
    shown = F.lit(size) if size else F.col("total")
    pages = pages_of(F.col("total"), size) if size else F.lit(1)
    return rows, total.select(F.lit(number).alias("page"), shown.cast("bigint").alias("limit"), "total", pages.cast("bigint").alias("total_pages"))


Order = Sequence[tuple[str, bool]]
#: Ranges of one pass of ``deep_page``, values sampled for their bounds, and rows that are simply sorted.
RANGES, SAMPLED, SORTED_ROWS = 64, 4096, 50_000


def sort_columns(order: Order) -> list[Column]:
    """(column, descending) pairs as the tracked database sorts: nulls first if descending, else last."""
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in order]


def _ranges(df: DataFrame, column: str, descending: bool) -> list[tuple[int, Column, bool]]:
    """(rows, condition, whether all rows are equal in ``column``) of ranges of a column in order; those without rows are left out.

    Bounds come from a sample of bounded size.  A bound is a range of its own, so a value that many rows share is told apart.
    """
    c = F.col(column)
    some = df.select(column).filter(c.isNotNull()).orderBy(F.rand(7)).limit(SAMPLED).collect()
    values = sorted(r[0] for r in some if r[0] == r[0])
    bounds = sorted({values[len(values) * k // RANGES] for k in range(RANGES)}) if values else []
    held = F.array(*[F.lit(b) for b in bounds])
    place = F.size(F.filter(held, lambda b: b < c)) + F.size(F.filter(held, lambda b: b <= c)) if bounds else F.lit(0)
    counts = {r["k"]: r["n"] for r in df.groupBy(F.when(c.isNotNull(), place).alias("k")).agg(F.count("*").alias("n")).collect()}  # 2 * RANGES + 2 rows at most
    out = []
    for k in sorted(x for x in counts if x is not None):
        low, equal = bounds[k // 2 - 1] if k > 1 else None, k % 2 == 1
        high = bounds[k // 2] if k // 2 < len(bounds) else None
        if equal:
            hit = c == F.lit(high)
        else:
            hit = F.lit(True) if low is None else c > F.lit(low)
            hit = (hit if high is None else hit & (c < F.lit(high))) & c.isNotNull()
        out.append((counts[k], hit, equal))
    out = out[::-1] if descending else out
    null = [(counts[None], c.isNull(), True)] if None in counts else []
    return null + out if descending else out + null


def _ranked(df: DataFrame, rows: int | None, low: int, high: int, order: Order, level: int, most: int) -> tuple[int, list[DataFrame]]:
    """(rows of ``df``, parts whose union has those of rank ``low`` to ``high`` - 1)."""
    if rows is not None and (rows <= most or level == len(order)):
        return rows, [df.orderBy(*sort_columns(order)).offset(low).limit(high - low)]
    before, parts = 0, []
    ranges = _ranges(df, *order[level])
    for n, hit, equal in ranges:
        a, b = max(low - before, 0), min(high - before, n)
        if a < b:
            alone = n == sum(r[0] for r in ranges)  # nothing was parted: the next column decides
            parts += _ranked(df.filter(hit), n, a, b, order, level + (equal or alone), most)[1]
        before += n
    return before, parts


def deep_page(df: DataFrame, number: int, limit: int, order: Order, most: int = SORTED_ROWS) -> tuple[DataFrame, DataFrame]:
    """A page however far down, and its envelope (as ``page`` has it), without sorting the table.

    One pass counts the rows in ranges of the first column of ``order``; their sum is the exact total.  Only
    the range that holds the page is read on, by a filter that reaches the scan, and parted again while it
    has more than ``most`` rows: by the same column, or by the next one where all are equal.  ``order``
    should end with a key.  Runs its counting passes when called.
    """
    if limit <= 0 or number < 1:
        raise ValueError(f"page {number} of {limit}")
    low = (number - 1) * limit
    total, parts = _ranked(df, None, low, low + limit, order, 0, most)
    rows = reduce(DataFrame.unionByName, parts).orderBy(*sort_columns(order)).limit(limit) if parts else df.limit(0)
    pages = -(-total // limit)
    return rows, df.sparkSession.createDataFrame([(number, limit, total, pages)], "page int, limit long, total long, total_pages long")


def page_links(envelope: DataFrame) -> DataFrame:
    """(page, gap_before) of the links shown around the current page."""
    at = F.col("page")
    shown = envelope.select(at.alias("current"), F.explode(F.sequence(F.lit(1), F.greatest("total_pages", F.lit(1)).cast("int"))).alias("page"), "total_pages")
    shown = shown.filter((F.col("page") == 1) | (F.col("page") == F.col("total_pages")) | (F.abs(F.col("page") - F.col("current")) <= 1))
    prev = F.lag("page").over(W.partitionBy("current").orderBy("page"))
    return shown.select("page", F.coalesce(prev != F.col("page") - 1, F.lit(False)).alias("gap_before"))


def newest(df: DataFrame, column: str, key: str) -> list[Column]:
    """Descending with nulls first, as the tracked database sorts, and the key for a total order."""
    return [F.col(column).desc_nulls_first(), F.col(key).asc()]


def top_per(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("rn", rank).filter(F.col("rn") <= k)
