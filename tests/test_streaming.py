import datetime as dt

from pyspark.sql import functions as F

from pipetally.streaming import polls


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_reminders_are_sent_once(spark, tmp_path):
    t = dt.datetime(2024, 5, 1, 12)
    rows = [(1, t, t + dt.timedelta(hours=24)), (1, t + dt.timedelta(minutes=5), t + dt.timedelta(hours=24)), (2, t, t + dt.timedelta(hours=30)), (3, t, t + dt.timedelta(hours=23)), (4, t, t + dt.timedelta(hours=25))]
    df = spark.createDataFrame(rows, "round_id int, seen_at timestamp, scheduled_date timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.round_id for r in run(spark, polls.reminders_due(stream), "due")) == [1, 3]


def test_daily_and_weekly_activity(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{small}/event*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.day, r.event_type): r.n for r in run(spark, polls.daily_activity(stream), "daily", "complete")}
    want = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    weeks = {r.wk: r.n for r in run(spark, polls.weekly_activity(stream), "weekly", "complete")}
    assert weeks == {r.wk: r.n for r in events.groupBy(F.trunc("ts", "week").alias("wk")).agg(F.count("*").alias("n")).collect()}
