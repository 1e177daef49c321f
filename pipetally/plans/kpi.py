"""The dashboard: ten indicators of every tenant, from one daily aggregate of each fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.functions.dates import date_windows
from pipetally.functions.numbers import pct_change, ratio_pct
from pipetally.operators.aggregates import count_if, valid_day
from pipetally.operators.changes import column_or

# The goals of a tenant who set none.
DAILY_GOAL, MONTHLY_GOAL, TREND_DAYS = 10, 200, 14
# The indicators and their titles, in order; their descriptions stand in ``kpi_table``.
TITLES = {
    "total-applications": "Total Applications", "pending-tasks": "Pending Tasks", "upcoming-interviews": "Upcoming Interviews", "monthly-goal": "Monthly Application Goal",
    "daily-goal": "Daily Application Goal", "velocity-change": "Application Velocity Change", "application-streak": "Application Streak", "silence-rate": "Silence Rate",
    "most-productive-week": "Most Productive Week", "current-momentum": "Current Momentum",
}


def _sum_if(n: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0)).cast("bigint")


def _trend(as_of: Column) -> Column:
    """The counts of the last days from (day, n) rows, gaps 0: an array."""
    by_day = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("day").between(F.date_sub(as_of, TREND_DAYS - 1), as_of), F.struct("day", "n"))), lambda z: z.isNotNull()))
    days = F.sequence(F.date_sub(as_of, TREND_DAYS - 1), as_of)
    return F.transform(days, lambda d: F.coalesce(F.try_element_at(by_day, d), F.lit(0)).cast("bigint"))


def _running(trend: Column) -> Column:
    ends = F.sequence(F.lit(1), F.size(trend))
    return F.transform(ends, lambda k: F.aggregate(F.slice(trend, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x))


def _halves(trend: Column) -> tuple[Column, Column]:
    add = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return add(F.slice(trend, 8, 7)), add(F.slice(trend, 1, 7))


def _with_weeks_and_runs(daily: DataFrame, as_of: Column) -> DataFrame:
    """``daily`` (with daily_goal) with its week's count, the week's place from the last, and places in runs of met goals.

    All windows are within a tenant, so one shuffle by tenant serves them and the aggregate after.
    """
    day, tenant = F.col("day"), W.partitionBy("user_id")
    met = F.coalesce((F.col("n") >= F.col("daily_goal")) & (F.col("daily_goal") > 0) & (day <= as_of), F.lit(False))
    rows = daily.withColumns({"wk": F.trunc(day, "week"), "met": met})
    rows = rows.withColumn("wk_back", F.dense_rank().over(tenant.orderBy(F.desc_nulls_last("wk"))))
    week, run = W.partitionBy("user_id", "wk"), W.partitionBy("user_id", "met")
    return rows.withColumns({
        "wk_n": F.sum("n").over(week), "wk_first": day.isNotNull() & (F.row_number().over(week.orderBy("day")) == 1),
        "back": F.row_number().over(run.orderBy(F.desc("day"))) - 1, "today_met": F.max(F.when(day == as_of, 1).otherwise(0)).over(run),
    })


def kpi_base(apps: DataFrame, tasks: DataFrame, rounds: DataFrame, profiles: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """One row a tenant with every number that the indicators are made of; tenants without any rows have zeros."""
    w = date_windows(as_of)
    applied = count_if(F.col("status") == "Applied")
    daily = apps.groupBy("user_id", valid_day("application_date").alias("day")).agg(F.count("*").alias("n"), applied.alias("applied"))
    goals = profiles.select(
        F.col("id").alias("user_id"), column_or(profiles, "daily_application_goal", DAILY_GOAL).cast("bigint").alias("daily_goal"),
        column_or(profiles, "monthly_application_goal", MONTHLY_GOAL).cast("bigint").alias("monthly_goal"),
    )
    daily = _with_weeks_and_runs(daily.join(goals.select("user_id", "daily_goal"), "user_id"), as_of)
    day = F.col("day")
    week = F.when(F.col("wk_first"), F.struct(F.col("wk_n").alias("n"), (-F.datediff("wk", F.lit("1970-01-01").cast("date"))).alias("o"), "wk"))
    old, before = day <= F.date_sub(as_of, 14), day.between(F.date_sub(as_of, 28), F.date_sub(as_of, 15))
    a = daily.groupBy("user_id").agg(
        F.sum("n").cast("bigint").alias("total"), F.sum("applied").cast("bigint").alias("applied"), *[_sum_if("n", day.between(lo, hi)).alias(k) for k, (lo, hi) in w.items()],
        _sum_if("n", old).alias("old"), _sum_if("applied", old).alias("silent"), _sum_if("n", before).alias("before"), _sum_if("applied", before).alias("silent_before"), _trend(as_of).alias("trend"),
        F.max(week).alias("best"), F.avg(F.when(F.col("wk_first") & (F.col("wk_back") <= 8), F.col("wk_n"))).alias("recent_mean"),
        count_if(F.col("met") & (F.datediff(as_of, day) == F.col("back"))).alias("streak"),
        count_if(F.col("met") & (day < as_of) & (F.datediff(as_of, day) - 1 == F.col("back") - F.col("today_met"))).alias("streak_before"),
    )
    a = a.withColumns({"best_week": F.col("best.wk"), "best_n": F.col("best.n"), "week_change": pct_change(F.col("best.n"), F.col("recent_mean"))}).drop("best", "recent_mean")
    t = tasks.groupBy("user_id", valid_day("created_at").alias("day")).agg(F.count("*").alias("n"), count_if(F.col("status") == "Pending").alias("pending"))
    t = t.groupBy("user_id").agg(F.sum("pending").cast("bigint").alias("pending_tasks"), _trend(as_of).alias("task_trend"))
    # only the days of the trend and what is still to come count
    rounds = rounds.filter(F.col("scheduled_date") >= F.least(F.date_sub(as_of, TREND_DAYS - 1).cast("timestamp_ntz"), now.cast("timestamp_ntz")))
    r = rounds.groupBy("user_id", valid_day("scheduled_date").alias("day")).agg(F.count("*").alias("n"), count_if(F.col("scheduled_date") >= now).alias("upcoming"))
    r = r.groupBy("user_id").agg(F.sum("upcoming").cast("bigint").alias("upcoming"), _trend(as_of).alias("round_trend"))
    out = goals.join(a, "user_id", "left").join(t, "user_id", "left").join(r, "user_id", "left")
    numbers = ["total", "applied", *w, "old", "silent", "before", "silent_before", "best_n", "streak", "streak_before", "pending_tasks", "upcoming", "week_change"]
    zeros = F.array_repeat(F.lit(0).cast("bigint"), TREND_DAYS)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers} | {c: F.coalesce(c, zeros) for c in ("trend", "task_trend", "round_trend")})


def kpi_table(apps: DataFrame, tasks: DataFrame, rounds: DataFrame, profiles: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """(user_id, ord, id, title, value_num, value_text, description, change_pct, progress, trend): ten rows a tenant.

    ``value_text`` is what the dashboard shows; ``value_num`` is the number in it.
    """
    c = F.col
    velocity = pct_change(c("last_7"), c("prev_7"))
    silence, silence_before = ratio_pct(c("silent"), c("old")), ratio_pct(c("silent_before"), c("before"))
    (task_now, task_before), (round_now, round_before) = _halves(c("task_trend")), _halves(c("round_trend"))
    goal = lambda n, g: F.when(c(g) > 0, F.concat_ws("/", c(n).cast("string"), c(g).cast("string"))).otherwise("Set a goal")
    progress = lambda n, g: F.when(c(g) > 0, F.least(c(n) / c(g), F.lit(1.0))).otherwise(F.lit(0.0))
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("double")
    week = F.when(c("best_week").isNotNull(), F.concat(F.lit("Week of "), text(c("best_week")))).otherwise("No activity yet")
    rows = [
        ("total-applications", c("total"), text(c("total")), "Applications submitted", velocity, none, _running(c("trend"))),
        ("pending-tasks", c("pending_tasks"), text(c("pending_tasks")), "Tasks to complete", pct_change(task_now, task_before), none, c("task_trend")),
        ("upcoming-interviews", c("upcoming"), text(c("upcoming")), "Scheduled interviews", pct_change(round_now, round_before), none, c("round_trend")),
        ("monthly-goal", c("month"), goal("month", "monthly_goal"), "Month-to-date progress", pct_change(c("month"), c("prev_month")), progress("month", "monthly_goal"), c("trend")),
        ("daily-goal", c("today"), goal("today", "daily_goal"), "Today", pct_change(c("today"), c("yesterday")), progress("today", "daily_goal"), c("trend")),
        ("velocity-change", velocity, F.concat(text(velocity), F.lit("%")), "vs last week", velocity, none, c("trend")),
        ("application-streak", c("streak"), F.concat(text(c("streak")), F.lit(" days")), "Days meeting daily goal", pct_change(c("streak"), c("streak_before")), none, c("trend")),
        ("silence-rate", silence, F.concat(text(silence), F.lit("%")), "No response after 14 days", pct_change(silence, silence_before), none, c("trend")),
        ("most-productive-week", c("best_n"), F.when(c("best_n") > 0, F.concat(text(c("best_n")), F.lit(" apps"))).otherwise("No data"), week, c("week_change"), none, c("trend")),
        ("current-momentum", c("last_7") / 7, F.concat(F.format_string("%.1f", c("last_7") / 7), F.lit("/day")), "7-day average", pct_change(c("last_7") / 7, c("prev_7") / 7), none, c("trend")),
    ]
    structs = [
        F.struct(
            F.lit(k).alias("ord"), F.lit(i).alias("id"), F.lit(TITLES[i]).alias("title"), num.cast("double").alias("value_num"), txt.alias("value_text"), (F.lit(d) if isinstance(d, str) else d).alias("description"),
            ch.cast("bigint").alias("change_pct"), pr.cast("double").alias("progress"), tr.alias("trend"),
        )
        for k, (i, num, txt, d, ch, pr, tr) in enumerate(rows, 1)
    ]
    return kpi_base(apps, tasks, rounds, profiles, as_of, now).select("user_id", F.inline(F.array(*structs)))


def kpi_json(kpis: DataFrame) -> DataFrame:
    """(user_id, body): the indicators of a tenant as one JSON text."""
    row = F.struct("ord", "id", "title", F.col("value_text").alias("value"), "description", "change_pct", "progress", "trend")
    return kpis.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("body"))
