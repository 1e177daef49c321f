"""Group counts, windows of days, series, streaks, weeks and rates; all tenants in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.functions.dates import week_start
from pipetally.functions.numbers import pct_change, ratio_pct
from pipetally.sources.crosswalk import APPLICATION_STATUS


def valid_day(column: str) -> Column:
    """The UTC day of a date, a time or a text; null where it is none."""
    return F.col(column).try_cast("date")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_breakdown(apps: DataFrame) -> DataFrame:
    return apps.groupBy("user_id", "status").agg(F.count("*").alias("cnt"))


def daily_counts(df: DataFrame, date_col: str, key: str = "user_id") -> DataFrame:
    """(key, day, n) of the rows with a valid day."""
    return df.select(key, valid_day(date_col).alias("day")).filter("day is not null").groupBy(key, "day").agg(F.count("*").alias("n"))


def window_counts(df: DataFrame, date_col: str, windows: dict[str, tuple[Column, Column]], key: str = "user_id") -> DataFrame:
    """One column of counts for each closed window of days, in one pass."""
    day = valid_day(date_col)
    return df.groupBy(key).agg(*[count_if(day.between(lo, hi)).alias(name) for name, (lo, hi) in windows.items()])


def every_day(counts: DataFrame, key: str = "user_id") -> DataFrame:
    """``counts`` (key, day, n) and the days between a key's first and last that have none, with 0: each day brings those up to the next one."""
    after = F.lead("day").over(W.partitionBy(key).orderBy("day"))
    rows = counts.withColumn("__to", F.coalesce(F.date_sub(after, 1), F.col("day")))
    rows = rows.select(key, F.col("day").alias("__from"), "n", F.explode(F.sequence("day", "__to")).alias("day"))
    return rows.select(key, "day", F.when(F.col("day") == F.col("__from"), F.col("n")).otherwise(0).cast("bigint").alias("n"))


def trailing_frames(counts: DataFrame, lengths: Sequence[int] = (7, 14, 30), key: str = "user_id") -> DataFrame:
    """(key, day, n) and, for each length, ``last_k``, ``prior_k`` and ``change_k`` of every day from a key's first to its last.

    ``last_k`` counts the k days up to a day, ``prior_k`` the k days before those, ``change_k`` is the
    change in percent.  Frames are ranges of days, not of rows, in one window that all lengths share.
    """
    at = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(key).orderBy(at)
    total = lambda lo, hi: F.coalesce(F.sum("n").over(w.rangeBetween(lo, hi)), F.lit(0)).cast("bigint")
    out = every_day(counts, key)
    out = out.select(key, "day", "n", *[c for k in lengths for c in (total(-k + 1, 0).alias(f"last_{k}"), total(-2 * k + 1, -k).alias(f"prior_{k}"))])
    return out.withColumns({f"change_{k}": pct_change(F.col(f"last_{k}"), F.col(f"prior_{k}")) for k in lengths})


def spine(keys: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Every key with each of the ``days`` days up to ``as_of``."""
    return keys.withColumn("day", F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)))


def with_spine(counts: DataFrame, as_of: Column, days: int, keys: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """``counts`` (key, day, n) with a row for each day, 0 where there was none."""
    keys = counts.select(key).distinct() if keys is None else keys
    recent = counts.filter(F.col("day").between(F.date_sub(as_of, days - 1), as_of))
    return spine(keys, as_of, days).join(recent, [key, "day"], "left").select(key, "day", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative(series: DataFrame, key: str = "user_id") -> DataFrame:
    run = F.sum("n").over(W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return series.withColumn("cumulative", run.cast("bigint"))


def timeseries(apps: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(user_id, day, n, cumulative): the running total starts from the rows before the first day."""
    counts = daily_counts(apps, "application_date")
    seed = counts.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("day") < F.date_sub(as_of, days - 1), F.col("n"))), F.lit(0)).alias("seed"))
    rows = cumulative(with_spine(counts, as_of, days, seed.select("user_id")))
    return rows.join(seed, "user_id").select("user_id", "day", "n", (F.col("cumulative") + F.col("seed")).cast("bigint").alias("cumulative"))


def streak(counts: DataFrame, anchor: Column, goal: Column, key: str = "user_id") -> DataFrame:
    """(key, streak): how many days in a row up to ``anchor`` reach the goal; keys without one are absent; a goal of 0 gives none."""
    met = counts.filter((F.col("n") >= goal) & (goal > 0) & (F.col("day") <= anchor))
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc("day"))) - 1
    return met.withColumn("back", back).filter(F.datediff(anchor, F.col("day")) == F.col("back")).groupBy(key).agg(F.count("*").alias("streak"))


def weekly_counts(counts: DataFrame, key: str = "user_id") -> DataFrame:
    return counts.groupBy(key, week_start(F.col("day")).alias("wk")).agg(F.sum("n").cast("bigint").alias("n"))


def weekly_profile(counts: DataFrame, last_k: int = 8, key: str = "user_id") -> DataFrame:
    """(key, best_week, best_n, recent_mean, change): the fullest week (the earliest of equals) against the mean of the last weeks that have any."""
    weeks = weekly_counts(counts, key).withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("wk"))))
    best = F.max_by(F.struct("wk", "n"), F.struct("n", -F.datediff("wk", F.lit("1970-01-01").cast("date"))))
    out = weeks.groupBy(key).agg(best.alias("b"), F.avg(F.when(F.col("rn") <= last_k, F.col("n"))).alias("recent_mean"))
    out = out.select(key, F.col("b.wk").alias("best_week"), F.col("b.n").alias("best_n"), "recent_mean")
    return out.withColumn("change", pct_change(F.col("best_n"), F.col("recent_mean")))


def stage_flow(apps: DataFrame, rounds: DataFrame) -> DataFrame:
    """Wide counts by stage and drop-off for each tenant with an application, 0 where there are none.

    Rounds need no tenant: an application with a failed one counts once, as its own tenant's.
    """
    names = ["applied", "interview_scheduled", "interview_completed", "offer_received", "rejected", "withdrawn"]
    failed = rounds.filter(F.col("result") == "Failed").select(F.col("application_id").alias("id")).distinct().withColumn("failed", F.lit(True))
    stages = [count_if(F.col("status") == s).alias(n) for s, n in zip(APPLICATION_STATUS, names)]
    out = apps.select("id", "user_id", "status").join(failed, "id", "left").groupBy("user_id").agg(*stages, F.count("failed").alias("rejected_after_interview"))
    total = sum((F.col(n) for n in [*names, "rejected_after_interview"]), F.lit(0))
    return out.withColumn("flow_total", total.cast("bigint"))


def rates(apps: DataFrame, as_of: Column) -> DataFrame:
    """Response, drop-off and silence rates of each tenant, the last against its earlier window."""
    day, applied = valid_day("application_date"), F.col("status") == "Applied"
    old, before = day <= F.date_sub(as_of, 14), day.between(F.date_sub(as_of, 28), F.date_sub(as_of, 15))
    out = apps.groupBy("user_id").agg(
        F.count("*").alias("total"), count_if(applied).alias("applied"), count_if(F.col("status").isin("Rejected", "Withdrawn")).alias("dropped"),
        count_if(old).alias("old"), count_if(old & applied).alias("silent"), count_if(before).alias("before"), count_if(before & applied).alias("silent_before"),
    )
    c = F.col
    out = out.select(
        "user_id", "total", ratio_pct(F.greatest(c("total") - c("applied"), F.lit(0)), c("total")).alias("response_rate"), ratio_pct(c("dropped"), c("total")).alias("drop_off_rate"),
        ratio_pct(c("silent"), c("old")).alias("silence_rate"), ratio_pct(c("silent_before"), c("before")).alias("silence_before"),
    )
    return out.withColumn("silence_change", pct_change(c("silence_rate"), c("silence_before")))


def status_insights(breakdown: DataFrame) -> DataFrame:
    """(user_id, top_status, top_count, total, drop_off_rate): equal counts keep the declared order."""
    order = F.array_position(F.array(*[F.lit(s) for s in APPLICATION_STATUS]), F.col("status"))
    known = F.when(order > 0, F.struct(F.col("cnt"), (-order).alias("o"), F.col("status")))
    out = breakdown.groupBy("user_id").agg(
        F.max(known).alias("t"), F.sum("cnt").cast("bigint").alias("total"),
        F.coalesce(F.sum(F.when(F.col("status").isin("Rejected", "Withdrawn"), F.col("cnt"))), F.lit(0)).alias("dropped"),
    )
    return out.select("user_id", F.coalesce("t.status", F.lit("Applied")).alias("top_status"), F.coalesce("t.cnt", F.lit(0)).alias("top_count"), "total", ratio_pct(F.col("dropped"), F.col("total")).alias("drop_off_rate"))


def sparkline(series: DataFrame, column: str = "n", key: str = "user_id") -> DataFrame:
    """(key, trend): the values of a gap-free series in order of day."""
    pairs = F.sort_array(F.collect_list(F.struct("day", F.col(column).alias("v"))))
    return series.groupBy(key).agg(F.transform(pairs, lambda z: z.v).alias("trend"))

