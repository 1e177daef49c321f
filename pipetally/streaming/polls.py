"""Time-triggered work as Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipetally.plans.reminders import HALF_WINDOW, LEADS, MOST, reminder_outbox


def reminders_due(rounds: DataFrame, lead_hours: int = 24, lateness: str = "2 hours") -> DataFrame:
    """A stream of rounds (round_id, seen_at, scheduled_date) that are seen within an hour of ``lead_hours`` ahead, each once.

    A round that no poll sees within its window is lost, as in the batch form; ``lateness`` bounds the
    state that remembers which rounds were sent.
    """
    ahead = F.unix_micros(F.col("scheduled_date").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))
    hour = 3_600_000_000
    due = rounds.filter((ahead >= (lead_hours - 1) * hour) & (ahead < (lead_hours + 1) * hour))
    return due.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["round_id"])


def daily_activity(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of counts by UTC day and type."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", lateness).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def weekly_activity(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """A stream of counts by Monday week; the epoch was a Thursday, so weeks start four days on."""
    w = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", lateness).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("wk"), "n")


def _held(spark: SparkSession, outbox: str, now: dt.datetime) -> DataFrame | None:
    """The messages of the polls of the last ``2 * HALF_WINDOW`` hours: no other can have sent what is due for the same lead now."""
    hours = {(now - dt.timedelta(hours=h)).strftime("%Y%m%d%H") for h in range(2 * HALF_WINDOW + 1)}
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(f"{outbox}/hour={h}" for h in hours):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        if at.getFileSystem(conf).exists(at):  # any other fault of the outbox is an error, not an empty outbox
            paths.append(name)
    return spark.read.option("basePath", outbox).parquet(*paths) if paths else None


def reminder_polls(ticks: DataFrame, rounds: Callable[[], DataFrame], profiles: DataFrame, apps: DataFrame, key: list[str], outbox: str, checkpoint: str, cap: int = MOST, order: list[Column] | None = None, stamped: dict[int, str] | None = None) -> StreamingQuery:
    """A stream of polls: every ``now`` (timestamp_ntz) of ``ticks`` writes its messages under ``outbox``, at most ``cap`` a lead.

    What the outbox holds is sent, so a later poll passes over it and takes the next rounds; a batch that is
    repeated after a failure overwrites its own part and does not see it.  A batch has a row a poll.
    A poll reads the rounds of its windows and the polls of the last two hours, however long the outbox is.
    ``stamped`` names, for each lead, a column of the rounds with older stamps: without it a round that
    moves after it was sent is sent for its new time too.
    """
    spark = ticks.sparkSession

    def poll(batch: DataFrame, batch_id: int) -> None:
        for k, r in enumerate(batch.select("now").distinct().orderBy("now").collect()):  # a row a poll
            part, now = batch_id * 1_000_000 + k, F.lit(r["now"]).cast("timestamp_ntz")
            at = lambda h: F.timestamp_add("HOUR", F.lit(h), now)  # noqa: E731, B023
            when = F.col("scheduled_date")
            near = rounds().filter((when >= at(min(LEADS) - HALF_WINDOW)) & (when < at(max(LEADS) + HALF_WINDOW)))
            flags = {h: f"__sent_{h}" for h in LEADS}
            old = {f: F.when(F.col((stamped or {})[h]).isNotNull(), True) if h in (stamped or {}) else F.lit(None).cast("boolean") for h, f in flags.items()}
            near, held = near.withColumns(old), _held(spark, outbox, r["now"])
            if held is not None:
                sent = held.filter(F.col("poll") < part).groupBy(*key).agg(*[F.max(F.when(F.col("lead") == h, True)).alias(f"__now{f}") for h, f in flags.items()])
                near = near.join(sent, key, "left").withColumns({f: F.coalesce(f, f"__now{f}") for f in flags.values()})
            box = reminder_outbox(near, profiles, apps, now, order or [F.col(c) for c in key], cap=cap, sent=flags)
            box.select(*key, "lead", "to", "subject", "text").write.mode("overwrite").parquet(f"{outbox}/hour={r['now'].strftime('%Y%m%d%H')}/poll={part}")

    return ticks.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
