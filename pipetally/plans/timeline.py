"""A tenant's or application's events as one timeline, and the two-week calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipetally.functions.dates import noon_in, wall_clock, week_start
from pipetally.functions.texts import role_at_company


def timeline(rounds: DataFrame, contacts: DataFrame, tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """(application_id, type, id, title, description, at, status); order by ``at`` descending, type and id for the newest first.

    A round or task without a date of its own counts from when it was made.
    """
    empty = F.lit(None).cast("string")
    col = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    ntz = lambda c: c.cast("timestamp_ntz")
    title = F.concat(F.col("interview_type"), F.lit(" Interview - Round "), F.col("round_number").cast("string"))
    parts = [
        rounds.select("application_id", F.lit("interview").alias("type"), F.col("id").cast("string").alias("id"), title.alias("title"), col(rounds, "interviewer_names").cast("string").alias("description"),
                      F.coalesce(ntz(F.col("scheduled_date")), ntz(col(rounds, "created_at"))).alias("at"), F.col("result").alias("status")),
        contacts.select("application_id", F.lit("contact").alias("type"), F.col("id").cast("string").alias("id"), F.concat(F.lit("Added contact: "), F.col("name")).alias("title"),
                        role_at_company(F.col("position"), F.col("company")).alias("description"), ntz(F.col("created_at")).alias("at"), empty.alias("status")),
        tasks.select("application_id", F.lit("task").alias("type"), F.col("id").cast("string").alias("id"), F.col("title").alias("title"), col(tasks, "description").cast("string").alias("description"),
                     F.coalesce(ntz(F.col("due_date")), ntz(F.col("created_at"))).alias("at"), F.col("status").alias("status")),
        documents.select("application_id", F.lit("document").alias("type"), F.col("id").cast("string").alias("id"), F.concat(F.lit("Uploaded: "), F.col("filename")).alias("title"),
                         empty.alias("description"), ntz(F.col("uploaded_at")).alias("at"), empty.alias("status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar_items(tasks: DataFrame, rounds: DataFrame, profiles: DataFrame, anchor: Column, weeks: int = 2) -> DataFrame:
    """(user_id, type, id, title, at, day): open tasks and interviews of the weeks from the anchor's Monday on.

    ``at`` is the wall-clock time in the tenant's zone; a due date stands for its noon in UTC.
    """
    zone = profiles.select(F.col("id").alias("user_id"), "time_zone")
    first = week_start(anchor)
    last = F.date_add(first, weeks * 7 - 1)
    # no zone is a day or more from UTC, so a wider range is cut before anything is joined
    near = lambda c: F.col(c).between(F.date_sub(first, 1).cast("timestamp_ntz"), F.date_add(last, 2).cast("timestamp_ntz"))
    due = tasks.filter((F.col("status") == "Pending") & F.col("due_date").between(F.date_sub(first, 1), F.date_add(last, 1))).join(zone, "user_id")
    due = due.select("user_id", F.lit("Task").alias("type"), F.col("id").cast("string").alias("id"), F.col("title"), noon_in(F.col("due_date"), F.col("time_zone")).alias("at"))
    met = rounds.filter(near("scheduled_date")).join(zone, "user_id")
    met = met.select("user_id", F.lit("Interview").alias("type"), F.col("id").cast("string").alias("id"), F.concat(F.lit("Interview · "), F.col("interview_type")).alias("title"),
                     wall_clock(F.col("scheduled_date"), F.col("time_zone")).alias("at"))
    day = F.col("at").cast("date")
    return due.unionByName(met).withColumn("day", day).filter(F.col("day").between(first, last))


def calendar(items: DataFrame) -> DataFrame:
    """(user_id, day, n, items): each day's items in order of time."""
    inside = F.sort_array(F.collect_list(F.struct("at", "type", "id", "title")))
    return items.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.transform(inside, lambda z: F.concat_ws(" ", z.type, z.id, z.title)).alias("items"))
