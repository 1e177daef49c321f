"""The tracking domain as views over the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipetally.operators.changes import ForeignKey, dealt

# The domains of the status columns.
APPLICATION_STATUS = ["Applied", "Interview Scheduled", "Interview Completed", "Offer Received", "Rejected", "Withdrawn"]
TASK_STATUS = {"click": "Pending", "signup": "Pending", "view": "In Progress", "purchase": "Completed", "error": "Cancelled"}
ROUND_RESULT = {"R": "Failed", "A": "Passed", "N": "Pending"}
PRIORITY = ["Low", "Medium", "High", "Critical"]
INTERVIEW_TYPE = ["Phone Screen", "Technical", "Behavioral", "Panel", "Final", "Other"]
ZONES = ["America/New_York", "UTC", "Asia/Kolkata", "Pacific/Auckland"]


def mapped(column: Column, values: dict, default: object = None) -> Column:
    """A constant map as a when-chain."""
    start = F.when(F.lit(False), F.lit(None))
    return reduce(lambda c, kv: c.when(column == kv[0], F.lit(kv[1])), values.items(), start).otherwise(F.lit(default))


def nth(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


#: The star-schema tables as they are stored: declared, so that no query begins with a job that reads footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, application_date, status, position_title) of each order."""
    s, p = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    status = (
        F.when(s == "O", "Applied").when((s == "P") & p.isin("1", "2"), "Interview Scheduled").when(s == "P", "Interview Completed")
        .when(p == "1", "Offer Received").when(p.isin("2", "3"), "Rejected").otherwise("Withdrawn")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("application_date"),
        status.alias("status"), F.col("o_orderpriority").alias("position_title"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("company_name"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interview rounds without their tenant: lineitems, whose key is (application_id, round_number, part, supplier)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("round_number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("scheduled_date"), mapped(F.col("l_returnflag"), ROUND_RESULT).alias("result"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("sent"), nth(F.col("l_partkey"), INTERVIEW_TYPE).alias("interview_type"),
    )


def tenant_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with the tenant of their application."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("user_id"))
    return rounds(spark, sf_dir).join(owner, "application_id")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, created_at, title, status, priority, due_date, props) of each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("title"),
        mapped(F.col("event_type"), TASK_STATUS).alias("status"), nth(F.col("event_id"), PRIORITY).alias("priority"),
        F.when(F.pmod("event_id", F.lit(10)) != 0, F.date_add(F.col("ts").cast("date"), F.pmod("event_id", F.lit(14)).cast("int"))).alias("due_date"), "props",
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, full_name, email, interview_reminders_enabled, time_zone); a few have no address or no preference."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("full_name"),
        F.when(F.pmod(key, F.lit(50)) != 7, F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email"),
        F.when(F.pmod(key, F.lit(20)) == 3, F.lit(None)).otherwise(F.col("c_mktsegment") != "MACHINERY").alias("interview_reminders_enabled"),
        F.when(F.pmod(key, F.lit(30)) == 4, "").otherwise(nth(key, ZONES)).alias("time_zone"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, application_id, name, position, company, created_at) of each supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("id"), key.alias("application_id"), F.col("s_name").alias("name"), F.when(F.pmod("s_nationkey", F.lit(3)) != 0, "Recruiter").alias("position"),
        F.when(F.pmod("s_nationkey", F.lit(5)) != 1, F.col("n_name")).alias("company"), F.timestamp_add("DAY", F.pmod(key, F.lit(30)).cast("int"), F.expr("timestamp_ntz'2001-06-01 09:00:00'")).alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, application_id, filename, file_type, file_size, uploaded_at, text) of each document."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        key.alias("id"), key.alias("application_id"), F.col("source").alias("filename"), F.col("lang").alias("file_type"), F.col("n_chars").alias("file_size"),
        F.timestamp_add("DAY", F.pmod(key, F.lit(30)).cast("int"), F.expr("timestamp_ntz'2001-06-01 12:00:00'")).alias("uploaded_at"), "text",
    )


# Which rows go with which.
FOREIGN_KEYS = [
    ForeignKey("applications", "user_id", "profiles"), ForeignKey("contacts", "user_id", "profiles"), ForeignKey("contacts", "application_id", "applications"),
    ForeignKey("interview_rounds", "user_id", "profiles"), ForeignKey("interview_rounds", "application_id", "applications"),
    ForeignKey("tasks", "user_id", "profiles"), ForeignKey("tasks", "application_id", "applications"),
    ForeignKey("documents", "user_id", "profiles"), ForeignKey("documents", "application_id", "applications"),
]


def sizes(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The rows of all tables by name, from the stored tables' footers."""
    held = {"profiles": "customer", "applications": "orders", "interview_rounds": "lineitem", "contacts": "supplier", "tasks": "events", "documents": "documents"}
    return {t: table(spark, sf_dir, name).count() for t, name in held.items()}


def domain(spark: SparkSession, sf_dir: str, rows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """All tables by name; children without a tenant of their own have that of their application, or none.

    With ``rows`` (of ``sizes``), what a task of these joins holds does not grow with the tables.
    """
    owner = applications(spark, sf_dir).select(F.col("id").alias("application_id"), "user_id")
    owned = lambda df, t: dealt(df, "application_id", (rows or {}).get(t)).join(owner, "application_id", "left")
    return {
        "profiles": profiles(spark, sf_dir), "applications": applications(spark, sf_dir), "interview_rounds": owned(rounds(spark, sf_dir), "interview_rounds"), "contacts": owned(contacts(spark, sf_dir), "contacts"),
        "tasks": tasks(spark, sf_dir).withColumn("application_id", F.when(F.pmod("id", F.lit(3)) != 0, F.col("id"))), "documents": owned(documents(spark, sf_dir), "documents"),
    }


# The same views for the oracle.
APPS_SQL = """apps as (select o_orderkey id, o_custkey user_id, cast(o_orderdate as date) application_date, o_orderpriority position_title,
  case when o_orderstatus = 'O' then 'Applied' when o_orderstatus = 'P' and o_orderpriority[1] in ('1', '2') then 'Interview Scheduled'
    when o_orderstatus = 'P' then 'Interview Completed' when o_orderpriority[1] = '1' then 'Offer Received'
    when o_orderpriority[1] in ('2', '3') then 'Rejected' else 'Withdrawn' end status from orders)"""
ROUNDS_SQL = """rounds as (select l_orderkey application_id, o_custkey user_id, l_linenumber round_number, l_partkey part, l_suppkey supplier, l_shipdate scheduled_date,
  case l_returnflag when 'R' then 'Failed' when 'A' then 'Passed' else 'Pending' end result, nullif(l_linestatus, 'O') sent,
  (['Phone Screen', 'Technical', 'Behavioral', 'Panel', 'Final', 'Other'])[l_partkey % 6 + 1] interview_type from lineitem join orders on l_orderkey = o_orderkey)"""
TASKS_SQL = """tasks as (select event_id id, user_id, ts created_at, event_type title, props,
  case event_type when 'click' then 'Pending' when 'signup' then 'Pending' when 'view' then 'In Progress' when 'purchase' then 'Completed' when 'error' then 'Cancelled' end status,
  (['Low', 'Medium', 'High', 'Critical'])[event_id % 4 + 1] priority,
  case when event_id % 10 <> 0 then cast(ts as date) + cast(event_id % 14 as int) end due_date from events)"""
PROFILES_SQL = """profiles as (select c_custkey id, c_name full_name, case when c_custkey % 50 <> 7 then lower(replace(c_name, '#', '.')) || '@example.com' end email,
  case when c_custkey % 20 = 3 then null else c_mktsegment <> 'MACHINERY' end interview_reminders_enabled,
  case when c_custkey % 30 = 4 then '' else (['America/New_York', 'UTC', 'Asia/Kolkata', 'Pacific/Auckland'])[c_custkey % 4 + 1] end time_zone from customer)"""
CONTACTS_SQL = """contacts as (select s_suppkey id, s_suppkey application_id, s_name "name", case when s_nationkey % 3 <> 0 then 'Recruiter' end "position",
  case when s_nationkey % 5 <> 1 then n_name end company, timestamp '2001-06-01 09:00:00' + to_days(cast(s_suppkey % 30 as int)) created_at
  from supplier join nation on s_nationkey = n_nationkey)"""
DOCS_SQL = """docs as (select doc_id id, doc_id application_id, source filename, lang file_type, n_chars file_size,
  timestamp '2001-06-01 12:00:00' + to_days(cast(doc_id % 30 as int)) uploaded_at, text from documents)"""
