"""Streams that keep state by key and act on event-time timers.

Both need the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` in the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from pipetally.plans.reminders import HALF_WINDOW, LEADS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: A round's state is kept so many hours after its time, so that a late update sends nothing twice.
KEPT_HOURS = 24


#: Rounds are dealt into so many buckets by their id; the state is a value a bucket.
BUCKETS = 1024
#: No time: the round is cancelled.
NEVER = -(1 << 63)
_ROUND = np.dtype([("id", "<i8"), ("at", "<i8"), ("seen", "<i8"), ("until", "<i8"), ("sent", "<i8")])


class _Reminders(StatefulProcessor):
    """A bucket of rounds: of each its time, when that was last heard of, until when it is kept, and a bit for each lead that was sent.

    One timer stands at the next moment at which a round of the bucket enters a lead's window or is forgotten.
    """

    def __init__(self, leads: tuple[int, ...], late_hours: float):
        self.leads, self.late = leads, int(late_hours * HOUR_MS)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rounds", "rounds binary, timer long")

    def _held(self) -> tuple[np.ndarray, int | None]:
        held = self.state.get()
        return (np.zeros(0, dtype=_ROUND), None) if held is None else (np.frombuffer(held[0], dtype=_ROUND), held[1])

    def _open(self, rounds: np.ndarray, i: int, now: int) -> np.ndarray:
        """Which rounds may still be sent, now or later, for lead i."""
        at, h = rounds["at"], self.leads[i]
        end = np.where(at == NEVER, 0, at) - int((h - HALF_WINDOW) * HOUR_MS) + self.late
        return (at != NEVER) & (rounds["sent"] >> i & 1 == 0) & (now < end) & (now < at)

    def _starts(self, rounds: np.ndarray, i: int) -> np.ndarray:
        return rounds["at"] - int((self.leads[i] + HALF_WINDOW) * HOUR_MS)

    def _keep(self, rounds: np.ndarray, timer: int | None, now: int) -> None:
        """Store the bucket, and move its timer (``timer``, if one stands) to what comes next."""
        if not len(rounds):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        times = [rounds["until"], *(self._starts(rounds[o], i) for i in range(len(self.leads)) for o in [self._open(rounds, i, now)])]
        following = min(int(t.min()) for t in times if len(t))
        if following != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(following)
        self.state.update((rounds.tobytes(), following))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        parts = [held]
        for b in rows:
            b = b[b["named"].to_numpy(dtype=bool)]
            part = np.zeros(len(b), dtype=_ROUND)
            for c in ("id", "at", "seen"):
                part[c] = b[c].to_numpy()
            parts.append(part)
        found = np.concatenate(parts)
        if len(found) == len(held):  # a tick only moves the clock
            return
        # the last word on a round counts; of equal ones that which came last
        found = found[np.lexsort((found["seen"], found["id"]))]
        found = found[np.append(found["id"][1:] != found["id"][:-1], True)]
        now = timerValues.getCurrentWatermarkInMs()
        at = np.where(found["at"] == NEVER, np.maximum(now, found["seen"]), found["at"])
        found["until"] = at + KEPT_HOURS * HOUR_MS
        place = np.searchsorted(found["id"], held["id"])  # every held round is still there
        same = found["at"][place] == held["at"]
        found["sent"][place] = held["sent"]
        found["until"][place[same]] = held["until"][same]
        self._keep(found, timer, now)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        rounds, now = held.copy(), timerValues.getCurrentWatermarkInMs()
        for i, h in enumerate(self.leads):
            due = self._open(rounds, i, now)
            due[due] = self._starts(rounds[due], i) < now
            rounds["sent"][due] |= 1 << i
            if due.any():
                yield pd.DataFrame({"round_id": rounds["id"][due], "lead": np.full(int(due.sum()), h, dtype=np.int32), "at": rounds["at"][due]})
        self._keep(rounds[rounds["until"] >= now], None, now)  # a timer that went off is gone

    def close(self) -> None:
        pass


def reminder_timers(rounds: DataFrame, leads: tuple[int, ...] = LEADS, late_hours: float = 0, lateness: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (round_id, lead, scheduled_date): each round once a lead, when the clock enters its window.

    ``rounds`` are updates (round_id long, seen_at, scheduled_date); of several the last by ``seen_at``
    counts, whenever it comes.  The clock is the watermark of ``seen_at``; a row with a null id only moves it.
    A round that moves before it was sent is sent at its new time alone; a null time cancels it; what was
    sent for a lead is not sent again.  A window that the clock jumped over is lost, unless it ended less
    than ``late_hours`` ago and the round is still ahead.  State is a few numbers a round, and goes
    ``KEPT_HOURS`` after it, so nothing that was sent is read again.

    Rounds share a state value and a timer with the others of their bucket (``buckets`` of them, fixed for a
    checkpoint), so a batch costs a few calls a bucket and not several a round; an update rewrites its bucket,
    of 40 bytes a round.
    """
    rows = rounds.select(F.col("round_id").cast("long").alias("id"), F.col("seen_at").cast("timestamp").alias("seen_at"), F.col("scheduled_date").cast("timestamp").alias("scheduled_date"))
    rows = rows.withWatermark("seen_at", lateness).select(
        F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "seen_at", (F.col("id").isNotNull() & F.col("seen_at").isNotNull()).alias("named"), F.coalesce("id", F.lit(0)).alias("id"),
        F.coalesce(F.unix_millis("scheduled_date"), F.lit(NEVER)).alias("at"), F.coalesce(F.unix_millis("seen_at"), F.lit(0)).alias("seen"))
    found = rows.groupBy("bucket").transformWithStateInPandas(_Reminders(leads, late_hours), "round_id long, lead int, at long", "Append", "EventTime")
    return found.select("round_id", "lead", F.timestamp_millis("at").alias("scheduled_date"))


def _daily(events: DataFrame, key: str, lateness: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", lateness).groupBy(w, key).agg(F.count("*").alias("n"))


def trailing_activity(events: DataFrame, days: int, key: str = "user_id", lateness: str = "1 day") -> DataFrame:
    """A stream of (key, day, n): the events of the ``days`` UTC days up to ``day``, for every day with any.

    Days are counted first, so a day, and not each of its events, is in ``days`` windows.
    """
    sliding = F.window(F.window_time("window"), f"{days} days", "1 day")
    out = _daily(events, key, lateness).groupBy(sliding, key).agg(F.sum("n").alias("n"))
    return out.select(key, F.date_sub(F.col("window.end").cast("date"), 1).alias("day"), "n")


class _Month(StatefulProcessor):
    """The running count of one key's month; another month starts it afresh."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("month", "month string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        month, total = tuple(self.state.get()) if self.state.exists() else (None, 0)
        for day, n in sorted((r["day"], r["n"]) for r in rows):
            if day.isoformat()[:7] != month:
                month, total = day.isoformat()[:7], 0
            total += n
            yield Row(key=key[0], day=day, n=n, month_to_date=total)
        self.state.update((month, total))

    def close(self) -> None:
        pass


def month_to_date(events: DataFrame, key: str = "user_id", lateness: str = "1 day") -> DataFrame:
    """A stream of (key, day, n, month_to_date) of every UTC day with events, in order of days: a day is counted when the watermark has passed it."""
    days = _daily(events, key, lateness).select(F.window_time("window").alias("t"), F.col(key).cast("long").alias(key), F.col("window.start").cast("date").alias("day"), "n")
    out = StructType.fromDDL("key long, day date, n long, month_to_date long")
    found = days.groupBy(key).transformWithState(_Month(), out, "Append", "None")
    return found.withColumnRenamed("key", key)
