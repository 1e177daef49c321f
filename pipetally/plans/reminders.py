"""Due-soon reminders: an outbox of messages, never a sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Hours of lead, half of the window in hours, most rounds of a run and lead.
LEADS, HALF_WINDOW, MOST = (24, 48), 1, 50
#: Picked rounds are broadcast up to so many.
BROADCAST_ROWS = 10_000


def wants_reminder(enabled: Column) -> Column:
    """A preference that was never set is a yes."""
    return F.coalesce(enabled, F.lit(True))


def due_rounds(rounds: DataFrame, now: Column, leads: tuple[int, ...] = LEADS, sent: dict[int, str] | None = None) -> DataFrame:
    """``rounds`` with ``lead``: unsent for it and scheduled in [now + lead - 1 h, now + lead + 1 h)."""
    at = lambda h: F.timestamp_add("HOUR", F.lit(h), now)
    when = F.col("scheduled_date")
    due = [F.when((when >= at(h - HALF_WINDOW)) & (when < at(h + HALF_WINDOW)) & F.col((sent or {}).get(h, "sent")).isNull(), F.lit(h)) for h in leads]
    # one scan, cut to all windows before the leads are told apart
    near = rounds.filter((when >= at(min(leads) - HALF_WINDOW)) & (when < at(max(leads) + HALF_WINDOW)))
    return near.withColumn("lead", F.explode(F.array_compact(F.array(*due))))


def capped(due: DataFrame, order: list[Column], most: int = MOST) -> DataFrame:
    """The first ``most`` rounds of each lead, before any preference is looked at."""
    return due.withColumn("rn", F.row_number().over(W.partitionBy("lead").orderBy(*order))).filter(F.col("rn") <= most).drop("rn")


def reminder_outbox(rounds: DataFrame, profiles: DataFrame, apps: DataFrame, now: Column, order: list[Column], leads: tuple[int, ...] = LEADS, cap: int = MOST, sent: dict[int, str] | None = None) -> DataFrame:
    """The capped rounds whose tenant has an address and wants mail, with ``to``, ``subject`` and ``text``.

    ``apps``: (application_id, user_id, company_name); a missing one is "your interview".
    """
    picked = capped(due_rounds(rounds, now, leads, sent), order, cap)
    who = profiles.select(F.col("id").alias("user_id"), "email", "interview_reminders_enabled")
    # at most ``cap`` rows a lead are picked, so theirs is the small side while the cap is
    small = F.broadcast if cap * len(leads) <= BROADCAST_ROWS else lambda df: df
    rows = who.join(small(picked), "user_id").filter((F.coalesce("email", F.lit("")) != "") & wants_reminder(F.col("interview_reminders_enabled")))
    keys = ["application_id", "user_id"]
    named = apps.join(small(rows.select(*keys).distinct()), keys).select(*keys, "company_name")
    rows = rows.join(small(named), keys, "left")
    # the wording is a fixed value
    company = F.coalesce("company_name", F.lit("your interview"))
    when = F.date_format("scheduled_date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    hours = F.col("lead").cast("string")
    return rows.withColumns({
        "to": F.col("email"), "subject": F.concat(F.lit("Interview reminder: "), company, F.lit(" in "), hours, F.lit(" hours")),
        "text": F.concat(F.lit("Reminder: your interview with "), company, F.lit(" is scheduled for "), when, F.lit(" (in "), hours, F.lit(" hours).")),
    })


def stamp_sent(rounds: DataFrame, outbox: DataFrame, key: list[str], column: str, now: Column) -> DataFrame:
    """``rounds`` with ``column`` set to ``now`` where the outbox holds them; what was stamped before stays."""
    hit = outbox.select(*key).distinct().withColumn("__hit", F.lit(True))
    out = rounds.join(hit, key, "left")
    return out.withColumn(column, F.coalesce(F.col(column), F.when(F.col("__hit"), now))).select(*rounds.columns)


# The wording of the messages below is a fixed value.


def _with_address(rows: DataFrame, profiles: DataFrame, preference: str) -> DataFrame:
    """``rows`` of tenants with an address who want this kind of mail, with ``to``."""
    wants = wants_reminder(F.col(preference)) if preference in profiles.columns else F.lit(True)
    who = profiles.filter((F.coalesce("email", F.lit("")) != "") & wants).select(F.col("id").alias("user_id"), F.col("email").alias("to"))
    return rows.join(who, "user_id")


def application_outbox(apps: DataFrame, profiles: DataFrame, product: str) -> DataFrame:
    """``apps`` that were saved, with ``to``, ``subject`` and ``text`` of the message about each."""
    c = F.col
    return _with_address(apps, profiles, "application_updates_enabled").withColumns({
        "subject": F.concat(F.lit("Application saved for "), c("company_name")),
        "text": F.concat(F.lit("Your application for "), c("position_title"), F.lit(" at "), c("company_name"), F.lit(f" was saved in {product}.")),
    })


def interview_outbox(rounds: DataFrame, profiles: DataFrame, apps: DataFrame) -> DataFrame:
    """``rounds`` that were scheduled, with ``to``, ``subject`` and ``text`` of the message about each.

    ``apps``: (application_id, user_id, company_name); a missing one is "your interview".  Rounds without a time get none.
    """
    rows = _with_address(rounds.filter(F.col("scheduled_date").isNotNull()), profiles, "interview_reminders_enabled")
    rows = rows.join(apps.select("application_id", "user_id", "company_name"), ["application_id", "user_id"], "left")
    company = F.coalesce("company_name", F.lit("your interview"))
    when = F.date_format("scheduled_date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.withColumns({
        "subject": F.concat(F.lit("Interview scheduled with "), company),
        "text": F.concat(F.lit("Your interview with "), company, F.lit(" is scheduled for "), when, F.lit(". We'll remind you ahead of time.")),
    })
