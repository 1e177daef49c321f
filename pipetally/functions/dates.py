"""Day, week, month and time-zone functions; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipetally.functions.texts import date_only

DEFAULT_ZONE = "America/New_York"


def zone_or_default(tz: Column) -> Column:
    return F.coalesce(F.nullif(tz, F.lit("")), F.lit(DEFAULT_ZONE))


def wall_clock(instant: Column, tz: Column) -> Column:
    """The wall-clock time (timestamp_ntz) that ``tz`` shows at a UTC instant given as timestamp_ntz."""
    return F.convert_timezone(F.lit("UTC"), tz, instant)


def zone_offset(instant: Column, tz: Column) -> Column:
    """Minutes by which the clock of ``tz`` is ahead of UTC at an instant."""
    return F.call_function("div", F.unix_micros(wall_clock(instant, tz).cast("timestamp")) - F.unix_micros(instant.cast("timestamp")), F.lit(60_000_000))


def iso_text(instant: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` of a UTC instant."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_instant(text: Column) -> Column:
    """The UTC instant (timestamp_ntz) of an ISO-8601 text, with or without a zone; null where it is none."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def wall_to_utc(wall: Column, tz: Column, strict: bool = False) -> Column:
    """The UTC instant (timestamp_ntz) of a wall-clock time.

    ``strict`` follows the zone's rules.  The default takes the offset that the zone has when the wall
    clock is read as UTC, as the tracked application does; it is an hour off around clock changes.
    """
    if strict:
        return F.convert_timezone(tz, F.lit("UTC"), wall)
    shift = F.unix_micros(wall_clock(wall, tz).cast("timestamp")) - F.unix_micros(wall.cast("timestamp"))
    return F.timestamp_add("MICROSECOND", -shift, wall)


def wall_text_to_utc(text: Column, tz: Column, strict: bool = False) -> Column:
    """ISO text of the UTC instant of ``yyyy-MM-ddTHH:mm``; other input is returned unchanged."""
    wall = F.when(text.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}"), F.try_to_timestamp(F.regexp_extract(text, r"^([^T]+T\d+:\d+)", 1)).cast("timestamp_ntz"))
    return F.coalesce(iso_text(wall_to_utc(wall, tz, strict)), text)


def today_in(as_of: Column, tz: Column) -> Column:
    return wall_clock(as_of, tz).cast("date")


def noon_in(day: Column, tz: Column) -> Column:
    """A date stands for its noon in UTC; the wall-clock time of that in ``tz``."""
    return wall_clock(F.timestamp_add("HOUR", F.lit(12), day.cast("timestamp_ntz")), tz)


def display_date(day: Column, tz: Column) -> Column:
    return F.coalesce(F.date_format(noon_in(day, tz), "MMM d, yyyy"), F.lit(""))


def display_day_text(text: Column, tz: Column, pattern: str = "MMM d, yyyy") -> Column:
    """A ``yyyy-MM-dd`` text as a date of ``tz`` in any pattern; other texts are shown as they are, null as empty."""
    return F.coalesce(F.date_format(noon_in(date_only(text), tz), pattern), text, F.lit(""))


# The patterns of the calendar's column heads, day numbers, day titles and times.
CALENDAR = {"weekday": "EEE", "day": "d", "title": "EEEE, MMM d", "time": "h:mm a"}


def calendar_label(at: Column, kind: str) -> Column:
    """A wall-clock time or day as the calendar writes it: weekday, day, title or time."""
    return F.date_format(at, CALENDAR[kind])


def display_time(instant: Column, tz: Column) -> Column:
    return F.coalesce(F.date_format(wall_clock(instant, tz), "MMM d, yyyy, h:mm a"), F.lit(""))


def input_time(instant: Column, tz: Column) -> Column:
    return F.coalesce(F.date_format(wall_clock(instant, tz), "yyyy-MM-dd'T'HH:mm"), F.lit(""))


def week_start(day: Column) -> Column:
    """The Monday on or before a day."""
    return F.trunc(day, "week")


def same_day_last_month(day: Column) -> Column:
    """A month earlier, at most that month's last day."""
    return F.add_months(day, -1)


def date_windows(as_of: Column) -> dict[str, tuple[Column, Column]]:
    """The closed windows that the indicators compare."""
    back = lambda n: F.date_sub(as_of, n)
    month = F.trunc(as_of, "MM")
    return {
        "last_7": (back(6), as_of), "prev_7": (back(13), back(7)), "today": (as_of, as_of), "yesterday": (back(1), back(1)),
        "month": (month, as_of), "prev_month": (F.add_months(month, -1), same_day_last_month(as_of)),
    }
