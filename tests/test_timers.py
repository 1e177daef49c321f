"""Timers, trailing windows and month counters on replayed streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pipetally.operators import aggregates as agg
from pipetally.streaming import timers

T = dt.datetime(2024, 5, 1, 12)
H = dt.timedelta(hours=1)
KINDS = "round_id long, seen_at timestamp, scheduled_date timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.PROVIDER)
    yield
    spark.conf.set(name, before)


class Replay:
    """Batches of updates, each followed by a run of the stream to its end."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.n = spark, path, options, 0

    def __call__(self, rows):
        if rows is not None:
            self.n += 1
            self.spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        stream = self.spark.readStream.schema(KINDS).parquet(f"{self.path}/in/*")
        found = timers.reminder_timers(stream, **self.options)
        found.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination(200)
        return sorted((r.round_id, r.lead, r.scheduled_date) for r in self.spark.read.schema("round_id long, lead int, scheduled_date timestamp").parquet(f"{self.path}/out").collect())


def test_rounds_fire_once_at_their_last_time(spark, tmp_path):
    run = Replay(spark, tmp_path)
    a, b, c = T + 30 * H, T + 60 * H, T + 70 * H
    assert run([(1, T, a), (2, T, b), (3, T, c), (4, T, a), (5, T, a), (None, T, None)]) == []
    # 1 moves away, 4 is cancelled, an older word about 5 comes late; the clock goes to where 24 h before a begins
    assert run([(1, T + H, c), (4, T + H, None), (5, T - H, c), (None, T + 5.5 * H, None)]) == [(5, 24, a)]
    again = [(5, 24, a)]
    assert run(None) == again  # a restart repeats nothing
    assert run([(5, T + 5.6 * H, a), (None, T + 6 * H, None)]) == again  # nor does an update with the same time
    got = run([(None, T + 11.5 * H, None)])
    assert got == sorted([*again, (2, 48, b)])
    got = run([(None, T + 21.5 * H, None)])
    assert got == sorted([*again, (2, 48, b), (1, 48, c), (3, 48, c)])  # 1 only at its new time


def test_windows_that_were_jumped_over(spark, tmp_path):
    a = T + 100 * H
    lost = Replay(spark, tmp_path / "lost")
    lost([(1, T, a), (None, T, None)])
    assert lost([(None, T + 60 * H, None)]) == []  # 48 h before ended at 53
    assert lost([(None, T + 76 * H, None)]) == [(1, 24, a)]
    late = Replay(spark, tmp_path / "late", late_hours=10)
    late([(1, T, a), (None, T, None)])
    assert late([(None, T + 60 * H, None)]) == [(1, 48, a)]
    assert late([(None, T + 101 * H, None)]) == [(1, 48, a)]  # the round is over


def test_state_is_kept_by_bucket(spark, tmp_path):
    """2,000 rounds are no more values and timers than the buckets; ids above 2^53 stay exact, beside rows without one."""
    big = 1 << 60
    rows = [(big + i, T, T + dt.timedelta(hours=24, minutes=i % 50)) for i in range(2000)] + [(None, T, None), (big + 5000, T, None)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/in/1")
    found = timers.reminder_timers(spark.readStream.schema(KINDS).parquet(f"{tmp_path}/in/*"))
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    rows_held = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    assert rows_held <= 3 * timers.BUCKETS  # a value, and a timer by key and by time
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.round_id, r.lead) for r in got) == [(big + i, 24) for i in range(2000)]


def replayed(spark, tmp_path, found, schema):
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(200)
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))


def stream_of(spark, tmp_path, rows):
    """Events in three batches; one far ahead closes all windows."""
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(3):
        spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(-1, dt.datetime(2030, 1, 1))], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    return spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


EVENTS = [(u, dt.datetime(2024, 1, 20, 23) + dt.timedelta(hours=(7 * i * (u + 1)) % 1900)) for u in range(3) for i in range(60)]


def test_trailing_counts_equal_the_batch_ones(spark, tmp_path):
    got = replayed(spark, tmp_path, timers.trailing_activity(stream_of(spark, tmp_path, EVENTS), 14), "user_id long, day date, n long")
    counts = agg.daily_counts(spark.createDataFrame(EVENTS, "user_id long, ts timestamp"), "ts")
    want = {(r.user_id, r.day): r.last_14 for r in agg.trailing_frames(counts, [14]).collect()}
    mine = {(u, d): n for u, d, n in got if (u, d) in want}
    assert mine == {k: n for k, n in want.items() if n}
    # after a key's last day the windows run out
    assert len([1 for u, d, n in got if u >= 0 and (u, d) not in want]) == 3 * 13


def test_month_to_date_starts_again(spark, tmp_path):
    got = replayed(spark, tmp_path, timers.month_to_date(stream_of(spark, tmp_path, EVENTS)), "user_id long, day date, n long, month_to_date long")
    days = {}
    for u, t in EVENTS:
        days[u, t.date()] = days.get((u, t.date()), 0) + 1
    want = sorted((u, d, n, sum(m for (v, e), m in days.items() if v == u and e <= d and (e.year, e.month) == (d.year, d.month))) for (u, d), n in days.items())
    assert got == want and len({(d.month) for _, d, _, _ in got}) > 2
