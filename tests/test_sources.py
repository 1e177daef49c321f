"""Files in and out, request bodies, and polls that stamp what they send."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pipetally.operators import rows
from pipetally.sources import csvio, requests
from pipetally.streaming import polls

LINE = '"{c}","Dev",2024-01-0{d},"Applied","","","","","say ""hi"""'


def test_export_is_one_file_byte_for_byte(spark, tmp_path):
    df = spark.createDataFrame([("A", "Dev", "2024-01-01", "Applied", 'say "hi"'), ("B", "Dev", "2024-01-02", "Applied", 'say "hi"')], "company_name string, position_title string, application_date string, status string, notes string")
    csvio.write_csv(df.repartition(4), f"file://{tmp_path}/out.csv", [F.desc("application_date")])
    want = ",".join(csvio.HEADER) + "\n" + LINE.format(c="B", d=2) + "\n" + LINE.format(c="A", d=1)
    assert (tmp_path / "out.csv").read_bytes() == want.encode()
    csvio.write_csv(df.limit(0), f"file://{tmp_path}/none.csv", [F.desc("application_date")])
    assert (tmp_path / "none.csv").read_bytes() == ",".join(csvio.HEADER).encode()


def test_import_numbers_large_files_by_split(spark, tmp_path):
    lines = [",".join(csvio.HEADER), ""] + [LINE.format(c=f"C{i}" if i != 700 else "", d=1 + i % 9) for i in range(1, 1001)]
    (tmp_path / "bad.csv").write_text("\n".join(lines))
    (tmp_path / "good.csv").write_text("\n".join(lines[:500]))
    (tmp_path / "short.csv").write_text("Company Name,Status\nx,Applied")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        good, errors = csvio.read_csv_rows(spark, f"file://{tmp_path}")
        got = {(r.file.rpartition("/")[2], r.message) for r in errors.collect()}
        assert got == {("bad.csv", "Row 701: Company name is required"), ("short.csv", "Missing required columns: position title, application date")}
        kept = sorted((r.n, r.company_name) for r in good.collect())
        assert kept == [(i + 1, f"C{i}") for i in range(1, 499)]
        apps = spark.createDataFrame([(1, 5, "x", dt.date(2024, 1, 1))], "id long, user_id long, company_name string, application_date date")
        after = csvio.import_applications(apps, good, F.lit(9).cast("long"))
        assert after.count() == 499 and after.filter("user_id = 9 and id is null and application_date is not null").count() == 498
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain_records(text):
    """Records of a text, newlines inside quotes kept, and whether the last is left open."""
    out, at, quoted = [], 0, False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c == "\n" and not quoted:
            out.append(text[at:i])
            at = i + 1
    return [r for r in [*out, text[at:]] if r.strip()]


RECORDS = [
    'Company Name,Position Title,Application Date,Status,Notes', 'A,Dev,2024-01-01,Applied,"one\n\ntwo, ""three""\n"', "", 'B,Dev,2024-01-02,Applied,plain',
    '"C\nc","D""\n""ev",2024-01-03,Applied,""', '"\n\n', '\n",Dev,2024-01-04,Applied,x', 'E,Dev,2024-01-05,Applied,"\r\n"', 'F,Dev,2024-01-06,Applied,"left ""open\nto the end\n',
]


def test_quoted_newlines_wherever_a_file_is_cut(spark, tmp_path):
    text = "\n".join(RECORDS)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_bytes(text.encode())
    (tmp_path / "a" / "y.csv").write_bytes(text.encode()[:200] + b"\n")
    want = {"x.csv": plain_records(text), "y.csv": plain_records(text[:200] + "\n")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1, 2, 3, 5, 17, 64, 100_000):  # 1: a split at every byte
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            lines = spark.read.text(f"file://{tmp_path}/a", lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
            got = csvio.quoted_records(lines, F.monotonically_increasing_id(), "path", "start").collect()
            assert size > 1 or len({r.start for r in got}) > 5
            for name, records in want.items():
                mine = sorted((r.start, r.at, r.value) for r in got if r.path.endswith(name) and r.value.strip())
                # a newline that ends the file belongs to an open record only in the plain version
                assert [v.rstrip("\n") for _, _, v in mine] == [r.rstrip("\n") for r in records], (size, name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_import_with_quoted_newlines(spark, tmp_path):
    rows = [f'C{i},Dev,2024-01-01,Applied,"note {i}\n\n ""q"" {"x" * (i % 50)}"' if i % 3 else f"C{i},Dev,2024-01-01,Applied,none" for i in range(500)]
    (tmp_path / "good.csv").write_text("\n".join([RECORDS[0], *rows]))
    (tmp_path / "bad.csv").write_text("\n".join([RECORDS[0], *rows[:9], ',Dev,2024-01-01,Applied,"\n"', *rows]))
    (tmp_path / "open.csv").write_text("\n".join([RECORDS[0], *rows[:9], 'Z,"Dev,2024-01-01,Applied,x', *rows[::3]]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        good, errors = csvio.read_csv_rows(spark, f"file://{tmp_path}", multi_line=True, longest=200)
        got = {r.file.rpartition("/")[2]: r.message for r in errors.collect() if r.message.startswith(("Row 11:", "CSV"))}
        assert got["bad.csv"] == "Row 11: Company name is required" and got["open.csv"].startswith("Row 11: record of ")
        kept = sorted((r.n, r.company_name, r.notes) for r in good.collect())
        assert kept == [(i + 2, f"C{i}", f'note {i}\n\n "q" {"x" * (i % 50)}'.strip() if i % 3 else "none") for i in range(500)]
        assert csvio.read_csv_rows(spark, f"file://{tmp_path}/good.csv")[1].count() > 0  # a newline ends a row, unless asked for
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_of_an_import_are_split_once(spark):
    lines = spark.createDataFrame([(csvio.csv_header(), 0, "a"), ("C,P,2024-01-01,Applied", 1, "a"), ("C,,2024-01-01,Applied", 2, "a"), (csvio.csv_header(), 0, "b"), ("D,P,2024-01-01,Applied", 1, "b")], "value string, at long, name string")
    good, errors = csvio.parse_applications(lines, order=F.col("at"), file="name")
    assert [(r.file, r.company_name) for r in good.collect()] == [("b", "D")] and [r.message for r in errors.collect()] == ["Row 3: Position title is required"]
    for df in (good, errors):  # what is left to do neither numbers lines nor splits them
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "row_number" not in plan


def test_request_bodies(spark):
    bodies = spark.createDataFrame([(1, '{"a": 1, "b": null, "zz": 3}'), (2, '{"a": "no number"}'), (3, "nothing"), (4, None), (5, "{}"), (6, "[1]")], "id int, body string")
    good, bad = requests.parse_bodies(bodies, "a int, b string")
    assert sorted((r.id, r.a, r.b, sorted(r.given)) for r in good.collect()) == [(1, 1, None, ["a", "b", "zz"]), (5, None, None, [])]
    assert sorted(r.id for r in bad.collect()) == [2, 3, 4, 6]
    assert good.select(requests.updated_fields(F.col("given"), ["a", "b"]).alias("f")).filter("size(f) = 2").count() == 1


def test_an_empty_needle_matches_rows_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, c string")
    assert rows.search(df, ["c"], "").count() == 2


def test_polls_send_capped_and_never_twice(spark, tmp_path):
    now = dt.datetime(2024, 5, 1, 12)
    due = spark.createDataFrame([(i, 1, 1 + i % 2, now + dt.timedelta(hours=24, minutes=i % 30)) for i in range(6)], "round_id int, application_id int, user_id int, scheduled_date timestamp_ntz")
    who = spark.createDataFrame([(1, "a@x.org", True), (2, "b@x.org", False)], "id int, email string, interview_reminders_enabled boolean")
    apps = spark.createDataFrame([(1, 1, "Acme")], "application_id int, user_id int, company_name string")
    spark.createDataFrame([(now,)], "now timestamp_ntz").write.parquet(str(tmp_path / "ticks/1"))
    box, state = str(tmp_path / "box"), str(tmp_path / "state")

    def poll():
        ticks = spark.readStream.schema("now timestamp_ntz").parquet(str(tmp_path / "ticks/*"))
        polls.reminder_polls(ticks, lambda: due, who, apps, ["round_id"], box, state, cap=3).awaitTermination(120)
        return sorted((r.poll, r.round_id, r.subject) for r in spark.read.parquet(box).collect())

    first = poll()  # of the first three rounds one tenant wants no mail, and uses a place
    assert [(i, s) for _, i, s in first] == [(0, "Interview reminder: Acme in 24 hours"), (2, "Interview reminder: Acme in 24 hours")]
    spark.createDataFrame([(now + dt.timedelta(minutes=5),)], "now timestamp_ntz").write.parquet(str(tmp_path / "ticks/2"))
    assert [i for _, i, _ in poll()] == [0, 2, 4]  # what was sent is passed over, the opted out still use places


def test_polls_read_the_last_hours_and_fail_on_a_broken_outbox(spark, tmp_path):
    now = dt.datetime(2024, 5, 1, 12)
    rows_ = [(1, now + dt.timedelta(hours=24), None), (2, now + dt.timedelta(hours=24), now - dt.timedelta(days=9)), (3, now + dt.timedelta(hours=48), now - dt.timedelta(days=9))]
    due = spark.createDataFrame([(i, 1, 1, at, s) for i, at, s in rows_], "round_id int, application_id int, user_id int, scheduled_date timestamp_ntz, sent24 timestamp_ntz")
    who = spark.createDataFrame([(1, "a@x.org", True)], "id int, email string, interview_reminders_enabled boolean")
    apps = spark.createDataFrame([(1, 1, "Acme")], "application_id int, user_id int, company_name string")
    box = tmp_path / "box"
    for hour in ("2024043012", "2024050109"):  # long ago, and of another poll than the last: neither is opened
        (box / f"hour={hour}/poll=0").mkdir(parents=True)
        (box / f"hour={hour}/poll=0/part-0.parquet").write_text("no parquet")

    def poll(name, at):
        spark.createDataFrame([(at,)], "now timestamp_ntz").write.parquet(str(tmp_path / f"ticks-{name}/1"))
        ticks = spark.readStream.schema("now timestamp_ntz").parquet(str(tmp_path / f"ticks-{name}/*"))
        polls.reminder_polls(ticks, lambda: due, who, apps, ["round_id"], str(box), str(tmp_path / f"state-{name}"), stamped={24: "sent24"}).awaitTermination(120)

    poll("a", now)
    got = spark.read.parquet(str(box / "hour=2024050112")).collect()
    assert sorted((r.round_id, r.lead) for r in got) == [(1, 24), (3, 48)]
    with pytest.raises(Exception):
        poll("b", now.replace(hour=11))
