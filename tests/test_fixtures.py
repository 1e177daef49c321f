"""Hand-derived values: indicators, series, scalars, CSV, reminders, timeline and calendar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pipetally.functions import dates, numbers, texts
from pipetally.operators import aggregates as agg
from pipetally.operators import changes, rows, validation
from pipetally.plans import kpi, reminders
from pipetally.plans import timeline as tl
from pipetally.sources import blobs, csvio

APPS = [
    ("2024-03-31", "Applied"), ("2024-03-31", "Applied"), ("2024-03-30", "Interview Scheduled"), ("2024-03-30", "Applied"), ("2024-03-20", "Rejected"),
    ("2024-03-10", "Applied"), ("2024-02-29", "Applied"), ("2024-02-10", "Withdrawn"), ("2024-04-05", "Applied"),
]


@pytest.fixture(scope="module")
def apps(spark):
    rows_ = [(i, "u", d, s) for i, (d, s) in enumerate(APPS)]
    return spark.createDataFrame(rows_, "id int, user_id string, application_date string, status string")


def as_of():
    return F.lit("2024-03-31").cast("date")


def values(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_kpis(spark, apps):
    profiles = spark.createDataFrame([("u", 2, None), ("v", None, 5)], "id string, daily_application_goal int, monthly_application_goal int")
    tasks = spark.createDataFrame([], "user_id string, created_at timestamp_ntz, status string")
    rounds = spark.createDataFrame([], "user_id string, scheduled_date timestamp_ntz")
    out = kpi.kpi_table(apps, tasks, rounds, profiles, as_of(), F.expr("timestamp_ntz'2024-03-31 10:00:00'")).collect()
    got = {r.id: r for r in out if r.user_id == "u"}
    text = {k: (r.value_text, r.change_pct) for k, r in got.items()}
    assert text == {
        "total-applications": ("9", 300), "pending-tasks": ("0", 0), "upcoming-interviews": ("0", 0), "monthly-goal": ("6/200", 200), "daily-goal": ("2/2", 0),
        "velocity-change": ("300%", 300), "application-streak": ("2 days", 100), "silence-rate": ("67%", -33), "most-productive-week": ("4 apps", 167), "current-momentum": ("0.6/day", 300),
    }
    assert got["monthly-goal"].progress == 0.03 and got["daily-goal"].progress == 1
    assert got["most-productive-week"].description == "Week of 2024-03-25"
    assert got["daily-goal"].trend == [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 2]
    assert got["total-applications"].trend == [0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 3, 5]
    assert sorted(r.ord for r in got.values()) == list(range(1, 11))
    empty = {r.id: r.value_text for r in out if r.user_id == "v"}
    assert empty["monthly-goal"] == "0/5" and empty["most-productive-week"] == "No data" and empty["application-streak"] == "0 days"


def test_kpis_without_goal_columns(spark, apps):
    profiles = spark.createDataFrame([("u",)], "id string")
    tasks = spark.createDataFrame([("u", dt.datetime(2024, 3, 31, 5), "Pending")], "user_id string, created_at timestamp_ntz, status string")
    rounds = spark.createDataFrame([("u", dt.datetime(2024, 3, 31, 11))], "user_id string, scheduled_date timestamp_ntz")
    out = kpi.kpi_table(apps, tasks, rounds, profiles, as_of(), F.expr("timestamp_ntz'2024-03-31 10:00:00'"))
    got = {r.id: r.value_text for r in out.collect()}
    assert got["monthly-goal"] == "6/200" and got["daily-goal"] == "2/10" and got["pending-tasks"] == "1" and got["upcoming-interviews"] == "1"
    assert len(kpi.kpi_json(out).collect()) == 1


def test_windows_weeks_rates_and_series(apps):
    w = agg.window_counts(apps, "application_date", dates.date_windows(as_of())).first()
    assert (w.last_7, w.prev_7, w.month, w.prev_month, w.today, w.yesterday) == (4, 1, 6, 2, 2, 2)
    best = agg.weekly_profile(agg.daily_counts(apps, "application_date")).first()
    assert (str(best.best_week), best.best_n, best.recent_mean, best.change) == ("2024-03-25", 4, 1.5, 167)
    r = agg.rates(apps, as_of()).first()
    assert (r.response_rate, r.drop_off_rate, r.silence_rate, r.silence_before, r.silence_change) == (33, 22, 67, 100, -33)
    s = {str(x.day): (x.n, x.cumulative) for x in agg.timeseries(apps, as_of(), 30).collect()}
    assert len(s) == 30 and s["2024-03-02"] == (0, 2) and s["2024-03-10"] == (1, 3) and s["2024-03-20"] == (1, 4) and s["2024-03-30"] == (2, 6) and s["2024-03-31"] == (2, 8)
    top = agg.status_insights(agg.status_breakdown(apps)).first()
    assert (top.top_status, top.top_count, top.total, top.drop_off_rate) == ("Applied", 6, 9, 22)


def test_streak_goal_of_zero_and_gaps(apps):
    counts = agg.daily_counts(apps, "application_date")
    assert agg.streak(counts, as_of(), F.lit(2)).first().streak == 2
    assert agg.streak(counts, F.date_sub(as_of(), 1), F.lit(2)).first().streak == 1
    assert agg.streak(counts, as_of(), F.lit(0)).count() == 0


def test_invalid_dates_count_in_totals_only(spark):
    df = spark.createDataFrame([("u", "2024-01-05", "Applied"), ("u", "soon", "Applied"), ("u", None, "Rejected")], "user_id string, application_date string, status string")
    assert agg.daily_counts(df, "application_date").first().n == 1
    assert agg.rates(df, as_of()).first().total == 3


def test_numbers(spark):
    r, p = numbers.js_round, numbers.pct_change
    lit = F.lit
    assert values(spark, r(lit(-12.5)), r(lit(0.5)), r(lit(2.5))) == [-12, 1, 3]
    assert values(spark, p(lit(5), lit(0)), p(lit(0), lit(0)), p(lit(0), lit(4)), p(lit(3), lit(4))) == [100, 0, -100, -25]
    assert values(spark, numbers.leading_int(lit(" 12px")), numbers.leading_int(lit("px")), numbers.clamp(lit(7), 0, 5), numbers.pages_of(lit(11), 10)) == [12, None, 5, 2]
    flat = F.array(lit(3), lit(3))
    assert values(spark, numbers.normalised(flat), numbers.normalised(F.array(lit(0), lit(4)))) == [[32.0, 32.0], [32.0, 0.0]]


def test_texts(spark):
    lit = F.lit
    size = texts.human_size
    assert values(spark, size(lit(0)), size(lit(1024)), size(lit(1536)), size(lit(1048576)), size(lit(100)), size(lit(1536 * 1024**3))) == ["0 Bytes", "1 KB", "1.5 KB", "1 MB", "100 Bytes", "1536 GB"]
    assert values(spark, texts.initials(lit("ada  lovelace@x.org")), texts.trimmed(lit("\t a b \r\n")), texts.or_else(lit(""), "d")) == ["AL", "a b", "d"]
    at = texts.role_at_company
    none = lit(None).cast("string")
    assert values(spark, at(lit("pos"), lit("co")), at(lit("pos"), none), at(none, lit("co")), at(none, none)) == ["pos at co", "pos", "co", None]
    long = F.repeat(lit("x"), 500).cast("binary")
    assert "\n" not in values(spark, texts.unbroken_base64(long))[0]
    assert values(spark, blobs.decoded(blobs.data_url(long, lit("text/plain"))).cast("string"))[0] == "x" * 500


def test_time_zones(spark):
    ny, lit = F.lit("America/New_York"), F.lit
    w = dates.wall_text_to_utc
    assert values(spark, w(lit("2024-03-10T03:30"), ny, True), w(lit("2024-03-10T03:30"), ny), w(lit(""), ny), w(lit("2024-03-10"), ny)) == [
        "2024-03-10T07:30:00.000Z", "2024-03-10T08:30:00.000Z", "", "2024-03-10",
    ]
    t = F.expr("timestamp_ntz'2024-01-01 03:00:00'")
    assert values(spark, dates.input_time(t, ny), dates.display_time(t, ny), dates.today_in(t, ny)) == ["2023-12-31T22:00", "Dec 31, 2023, 10:00 PM", dt.date(2023, 12, 31)]
    day = lit("2024-01-01").cast("date")
    assert values(spark, dates.display_date(day, lit("Pacific/Auckland")), dates.display_date(day, ny)) == ["Jan 2, 2024", "Jan 1, 2024"]
    assert values(spark, dates.zone_or_default(lit("")), dates.same_day_last_month(lit("2024-03-31").cast("date"))) == ["America/New_York", dt.date(2024, 2, 29)]


def lines(spark, *text):
    return spark.createDataFrame(list(enumerate(text)), "at int, value string")


def test_csv_fields(spark):
    f = lambda s: values(spark, csvio.fields(F.lit(s)))[0]
    assert f('"a""b", c ,"d,e"') == ['a"b', "c", "d,e"]
    assert f('a,"b,c') == ["a", "b,c"] and f(',"",x') == ["", "", "x"] and f('""""') == ['"'] and f(" a b ,") == ["a b", ""]


HEAD = "Company Name,Position Title,Application Date,Status,Notes,Extra"


def test_csv_import(spark):
    good, bad = csvio.parse_applications(lines(spark, HEAD, "  ", "A,P,2024-01-01,Applied,n,zzz", '"B, Inc",Q,2024-01-02,Rejected'), order=F.col("at"))
    assert bad.count() == 0
    got = {r.n: (r.company_name, r.status, r.notes, r.location) for r in good.collect()}
    assert got == {2: ("A", "Applied", "n", None), 3: ("B, Inc", "Rejected", "", None)}
    good, bad = csvio.parse_applications(lines(spark, HEAD, "A,P,2024-01-01,Applied", ",P,2024-01-01,Applied"), order=F.col("at"))
    assert good.count() == 0 and [r.message for r in bad.collect()] == ["Row 3: Company name is required"]
    good, bad = csvio.parse_applications(lines(spark, HEAD), order=F.col("at"))
    assert good.count() == 0 and "at least one data row" in bad.first().message
    good, bad = csvio.parse_applications(lines(spark, "Company Name,Position Title,Application Date", "a,b,c"), order=F.col("at"))
    assert good.count() == 0 and bad.first().message == "Missing required columns: status"


def test_csv_repeated_header_is_last_wins(spark):
    good, _ = csvio.parse_applications(lines(spark, HEAD + ",status", "A,P,2024-01-01,Wrong,n,x,Applied"), order=F.col("at"))
    assert good.first().status == "Applied"


def test_csv_export_and_back(spark, tmp_path):
    rows_ = [('A "x", y', "P", "2024-01-01", "Applied", None, 'say "hi"'), ("B", "Q", "2024-01-02", "Rejected", "", None)]
    df = spark.createDataFrame(rows_, "company_name string, position_title string, application_date string, status string, location string, notes string")
    compat = sorted(r.value for r in csvio.csv_lines(df, compat=True).collect())[0]
    assert compat == '"A "x", y","P",2024-01-01,"Applied","","","","","say ""hi"""'
    csvio.write_csv(df, str(tmp_path / "out"), [F.desc("application_date")])
    text = spark.read.text(str(tmp_path / "out")).withColumn("at", F.when(F.col("value").startswith("Company"), 0).otherwise(1))
    good, bad = csvio.parse_applications(text, order=F.col("at"))
    assert bad.count() == 0
    assert sorted((r.company_name, r.status, r.notes) for r in good.collect()) == [('A "x", y', "Applied", 'say "hi"'), ("B", "Rejected", "")]


def test_reminders(spark):
    t = dt.datetime(2024, 5, 1, 12)
    h = lambda n: t + dt.timedelta(hours=n)
    rounds = [
        (1, "a", 1, h(23), None, None), (2, "a", 1, h(25), None, None), (3, "a", 1, h(24), "x", None), (4, "none", 1, h(24), None, None), (5, "out", 1, h(24), None, None),
        (6, "a", 99, h(24), None, None), (7, "a", 1, h(47), "x", None), (8, "noaddress", 1, h(24), None, None), (9, "null", 1, h(24), None, None),
    ]
    r = spark.createDataFrame(rounds, "id int, user_id string, application_id int, scheduled_date timestamp_ntz, sent24 string, sent48 string")
    p = spark.createDataFrame([("a", "a@x.org", True), ("out", "o@x.org", False), ("noaddress", None, True), ("null", "n@x.org", None)], "id string, email string, interview_reminders_enabled boolean")
    apps = spark.createDataFrame([(1, "a", "Acme")], "application_id int, user_id string, company_name string")
    now = F.expr("timestamp_ntz'2024-05-01 12:00:00'")
    box = reminders.reminder_outbox(r, p, apps, now, [F.col("id")], sent={24: "sent24", 48: "sent48"}).collect()
    assert sorted((x.id, x.lead) for x in box) == [(1, 24), (6, 24), (7, 48), (9, 24)]
    said = {x.id: (x.to, x.subject, x.text) for x in box}
    assert said[1] == ("a@x.org", "Interview reminder: Acme in 24 hours", "Reminder: your interview with Acme is scheduled for 2024-05-02T11:00:00.000Z (in 24 hours).")
    assert "your interview with your interview" in said[6][2]
    # those who opted out use up places
    few = reminders.reminder_outbox(r, p, apps, now, [F.col("user_id").desc(), F.col("id")], leads=(24,), cap=3, sent={24: "sent24"})
    assert [x.id for x in few.collect()] == [9]
    stamped = reminders.stamp_sent(r, spark.createDataFrame([(1,), (3,)], "id int"), ["id"], "sent24", F.lit("now"))
    assert {x.id: x.sent24 for x in stamped.collect() if x.sent24} == {1: "now", 3: "x", 7: "x"}


def test_timeline_and_calendar(spark):
    made = dt.datetime(2024, 5, 1)
    r = spark.createDataFrame([(1, 7, "Final", 2, None, made, "Passed"), (2, 7, "Panel", 1, dt.datetime(2024, 6, 1), made, None)], "id int, application_id int, interview_type string, round_number int, scheduled_date timestamp_ntz, created_at timestamp_ntz, result string")
    c = spark.createDataFrame([(1, 7, "Ann", None, "Acme", made)], "id int, application_id int, name string, position string, company string, created_at timestamp_ntz")
    t = spark.createDataFrame([(1, 7, "do", None, made, "Pending", "u"), (2, 7, "due", dt.date(2024, 5, 26), made, "Pending", "u")], "id int, application_id int, title string, due_date date, created_at timestamp_ntz, status string, user_id string")
    d = spark.createDataFrame([(1, 7, "cv.pdf", dt.datetime(2024, 4, 1))], "id int, application_id int, filename string, uploaded_at timestamp_ntz")
    got = tl.timeline(r, c, t, d).orderBy(F.desc("at"), "type", "id").collect()
    assert [x.title for x in got] == ["Panel Interview - Round 1", "due", "Added contact: Ann", "Final Interview - Round 2", "do", "Uploaded: cv.pdf"]
    assert got[2].description == "Acme"
    p = spark.createDataFrame([("u", "UTC")], "id string, time_zone string")
    items = tl.calendar_items(t, r.withColumn("user_id", F.lit("u")), p, F.lit("2024-05-15").cast("date")).collect()
    assert [(x.title, str(x.day)) for x in items] == [("due", "2024-05-26")]  # the last Sunday; undated ones are left out


def test_pages_and_single_rows(spark):
    df = spark.range(25).select("id")
    page, env = rows.page(df, 2, 10, [F.asc("id")])
    assert [r.id for r in page.collect()] == list(range(10, 20)) and tuple(env.first()) == (2, 10, 25, 3)
    page, env = rows.page(df, 1, "all", [F.asc("id")])
    assert page.count() == 25 and tuple(env.first()) == (1, 25, 25, 1)
    with pytest.raises(ValueError):
        rows.page(df, 1, "many", [F.asc("id")])
    env = spark.createDataFrame([(5, 10, 100, 10)], "page int, limit bigint, total bigint, total_pages bigint")
    assert [(r.page, r.gap_before) for r in rows.page_links(env).orderBy("page").collect()] == [(1, False), (4, True), (5, False), (6, False), (10, True)]
    assert rows.one_row(df.filter("id = 3")).first().id == 3
    assert rows.one_row(df.filter("id < 0"), required=False).count() == 0
    for bad in ("id < 0", "id < 2"):
        with pytest.raises(Exception):
            rows.one_row(df.filter(bad)).collect()


def test_search_wildcards_and_literals(spark):
    df = spark.createDataFrame([("Red_Ring", None), ("a%b", "x"), (None, "RED")], "a string, b string")
    assert rows.search(df, ["a", "b"], "red").count() == 2
    assert rows.search(df, ["a", "b"], "%").count() == 3
    assert rows.search(df, ["a", "b"], "%", literal=True).count() == 1
    assert rows.search(df, ["a", "b"], "", literal=True).count() == 3


def test_changes(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    c = spark.createDataFrame([(10, 1), (11, None), (12, 2)], "cid int, pid int")
    left, (kids,) = changes.delete_cascade(p, [c], p.filter("id = 1"), "id", "pid")
    assert [r.id for r in left.collect()] == [2] and sorted(r.cid for r in kids.collect()) == [11, 12]
    both = changes.insert_if_absent(p, spark.createDataFrame([(2, "z"), (3, "c"), (3, "c")], "id int, name string"), "id")
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in changes.schema_aware_update(p, F.col("id") == 1, {"name": F.lit("x"), "goal": F.lit(1)}).collect()) == [(1, "x"), (2, "b")]
    ids = changes.append_rows(p.select(F.col("id").cast("string").alias("id"), "name"), spark.createDataFrame([("n",)], "name string"), id_col="id").filter("name = 'n'").first().id
    assert len(ids) == 36
    assert changes.tenant_view(p, 2, "id").count() == 1


def test_rules(spark):
    df = spark.createDataFrame([("t", "Low", "Pending", None), ("", "None", None, "not-an-id")], "title string, priority string, status string, application_id string")
    good, bad = validation.split_valid(df, validation.task_rules())
    assert good.count() == 1 and bad.first().errors[0] == "Title is required" and len(bad.first().errors) == 4
    r = spark.createDataFrame([(None, 0, "Final", None, None)], "application_id string, round_number int, interview_type string, duration_minutes int, result string")
    assert validation.validate(r, validation.round_rules()).first().errors == ["Invalid application ID", "Round number must be positive"]
    c = spark.createDataFrame([("n", "", None), ("n", "bad", None), ("n", "a@b.co", None)], "name string, email string, application_id string")
    assert [len(x.errors) for x in validation.validate(c, validation.contact_rules()).collect()] == [0, 1, 0]
