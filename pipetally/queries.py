"""One registered query for each operation, over the star-schema tables, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.functions import dates, numbers, texts
from pipetally.operators import aggregates as agg
from pipetally.operators import changes, rows, stored, validation
from pipetally.plans import kpi, reminders
from pipetally.plans import timeline as tl
from pipetally.sources import blobs, csvio, folders, requests
from pipetally.sources import crosswalk as x
from pipetally.streaming import replay, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed points in time of the registered queries.
APPS_DAY, CLAMP_DAY, TASKS_DAY, NOW = "2001-08-01", "2001-03-31", "2024-01-30", "2001-06-02 00:00:00"


def day() -> Column:
    return F.lit(APPS_DAY).cast("date")


def tasks_day() -> Column:
    return F.lit(TASKS_DAY).cast("date")


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


A, R, T, P, C, D = (s + " " for s in (x.APPS_SQL, x.ROUNDS_SQL, x.TASKS_SQL, x.PROFILES_SQL, x.CONTACTS_SQL, x.DOCS_SQL))
PCT = "cast(case when {p} > 0 then floor(({c} - {p}) * 1.0 / {p} * 100 + 0.5) when {c} > 0 then 100 else 0 end as bigint)"
RATIO = "cast(case when {w} > 0 then floor({p} * 1.0 / {w} * 100 + 0.5) else 0 end as bigint)"


def pct(c: str, p: str) -> str:
    # a double division, like Spark's
    return f"cast(case when {p} > 0 then floor((cast({c} as double) - {p}) / {p} * 100 + 0.5) when {c} > 0 then 100 else 0 end as bigint)"


def ratio(p: str, w: str) -> str:
    return f"cast(case when {w} > 0 then floor(cast({p} as double) / {w} * 100 + 0.5) else 0 end as bigint)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- scans, filters, order, pages -------------------------------------------------------------------------------------


@query(f"with {A} select * from apps where user_id = 7")
def scan_tenant(spark, d):
    return changes.tenant_view(x.applications(spark, d), 7)


@query(f"with {A} select id, status from apps")
def scan_pruned(spark, d):
    return rows.select_rows(x.applications(spark, d), ["id", "status"])


@query(f"with {T} select user_id, count(*) pending from tasks where status = 'Pending' group by 1")
def count_pending(spark, d):
    return x.tasks(spark, d).filter("status = 'Pending'").groupBy("user_id").agg(F.count("*").alias("pending"))


@query(f"with {T} select count(*) total from tasks where user_id = 3 and status = 'Pending'")
def exact_count(spark, d):
    return rows.exact_count(x.tasks(spark, d).filter("user_id = 3 and status = 'Pending'"))


@query(f"with {A} select cast(1 as int) page, cast(10 as bigint) \"limit\", count(*) total, cast(ceil(count(*) / 10) as bigint) total_pages from apps where status = 'Applied'")
def page_envelope(spark, d):
    apps = x.applications(spark, d).filter("status = 'Applied'")
    return rows.page(apps, 1, 10, rows.newest(apps, "application_date", "id"))[1]


@query(f"with {A} select * from apps where status = 'Applied' order by application_date desc, id limit 10 offset 10")
def page_2(spark, d):
    apps = x.applications(spark, d).filter("status = 'Applied'")
    return rows.page(apps, 2, 10, rows.newest(apps, "application_date", "id"))[0]


@query(f"with {A} select * from apps order by application_date desc, id limit 20 offset 11980")
def page_deep(spark, d):
    """Page 600 of all applications, found by counts of ranges."""
    return rows.deep_page(x.applications(spark, d), 600, 20, [("application_date", True), ("id", False)], most=2_000)[0]


@query(f"with {A} select cast(600 as int) page, cast(20 as bigint) \"limit\", count(*) total, cast(ceil(count(*) / 20) as bigint) total_pages from apps")
def page_deep_envelope(spark, d):
    return rows.deep_page(x.applications(spark, d), 600, 20, [("application_date", True), ("id", False)], most=2_000)[1]


@query(f"with {A} select count(*) total, count(*) \"limit\", cast(1 as int) page, cast(1 as bigint) total_pages from apps where user_id = 7")
def page_all(spark, d):
    apps = x.applications(spark, d).filter("user_id = 7")
    return rows.page(apps, 1, "all", rows.newest(apps, "application_date", "id"))[1]


@query(f"""with {A}, e as (select cast(ceil(count(*) / 10) as int) n from apps where status = 'Applied'),
p as (select unnest(generate_series(1, n)) page, n from e), s as (select page from p where page = 1 or page = n or abs(page - 5) <= 1)
select cast(page as int) page, coalesce(lag(page) over (order by page) <> page - 1, false) gap_before from s""")
def page_links(spark, d):
    apps = x.applications(spark, d).filter("status = 'Applied'")
    return rows.page_links(rows.page(apps, 5, 10, rows.newest(apps, "application_date", "id"))[1])


@query(f"with {P} select id, full_name, email from profiles where id = 11")
def point_lookup(spark, d):
    return rows.one_row(x.profiles(spark, d).filter("id = 11").select("id", "full_name", "email"))


@query(f"with {P} select id, cast(200 as int) monthly_goal, cast(10 as int) daily_goal from profiles")
def profile_goals(spark, d):
    p = x.profiles(spark, d)  # its schema has no goals
    return p.select("id", changes.column_or(p, "monthly_application_goal", 200).alias("monthly_goal"), changes.column_or(p, "daily_application_goal", 10).alias("daily_goal"))


@query("select c_custkey id, coalesce(case when c_custkey % 2 = 0 then c_nationkey end, 200) monthly_goal, cast(10 as int) daily_goal from customer")
def profile_goals_set(spark, d):
    p = x.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("monthly_application_goal"))
    return p.select("id", changes.column_or(p, "monthly_application_goal", 200).alias("monthly_goal"), changes.column_or(p, "daily_application_goal", 10).alias("daily_goal"))


@query(f"with {A} select id, user_id, status from apps where status = 'Rejected'")
def filter_status(spark, d):
    return rows.select_rows(x.applications(spark, d), ["id", "user_id", "status"], where=rows.equal_if("status", "Rejected") + rows.equal_if("position_title", ""))


@query("select p_partkey, p_name, p_brand from part where p_name ilike '%RED%' or p_brand ilike '%RED%'")
def search_ilike(spark, d):
    return rows.search(x.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], "RED")


@query("select p_partkey, p_name, p_brand from part where p_name ilike '%b_u%' or p_brand ilike '%b_u%'")
def search_wildcard(spark, d):
    return rows.search(x.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], "b_u")


@query("select p_partkey, p_name, n from (select p_partkey, p_name, nullif(p_type, 'SMALL') n from part) where contains(lower(p_name), 'bolt') or contains(lower(coalesce(n, '')), 'bolt')")
def search_contains(spark, d):
    part = x.table(spark, d, "part").select("p_partkey", "p_name", F.nullif("p_type", F.lit("SMALL")).alias("n"))
    return rows.search(part, ["p_name", "n"], "BOLT", literal=True)


@query(f"with {R} select count(*) upcoming, user_id from rounds where scheduled_date >= timestamp '{NOW}' group by 2")
def upcoming_count(spark, d):
    return x.tenant_rounds(spark, d).filter(F.col("scheduled_date") >= now()).groupBy("user_id").agg(F.count("*").alias("upcoming"))


@query(f"with {T} select user_id, case when status = 'Completed' then 'completed' else 'pending' end bucket, count(*) n from tasks group by 1, 2")
def task_partition(spark, d):
    bucket = F.when(F.col("status") == "Completed", "completed").otherwise("pending")
    return x.tasks(spark, d).groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {R} select user_id, case when s > timestamp '{NOW}' then 'upcoming' else 'past' end bucket, count(*) n from (select user_id, case when part % 10 <> 0 then scheduled_date end s from rounds) group by 1, 2")
def interview_partition(spark, d):
    r = x.tenant_rounds(spark, d).withColumn("s", F.when(F.pmod("part", F.lit(10)) != 0, F.col("scheduled_date")))
    return r.groupBy("user_id", F.when(F.col("s") > now(), "upcoming").otherwise("past").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {A} select user_id, status, count(*) value, case status when 'Applied' then 'chart-1' when 'Interview Scheduled' then 'chart-2' when 'Interview Completed' then 'chart-3' when 'Offer Received' then 'chart-4' when 'Rejected' then 'chart-5' else 'muted' end colour from apps group by 1, 2")
def status_donut(spark, d):
    colours = {s: f"chart-{k}" for k, s in enumerate(x.APPLICATION_STATUS[:5], 1)}
    return agg.status_breakdown(x.applications(spark, d)).select("user_id", "status", F.col("cnt").alias("value"), x.mapped(F.col("status"), colours, "muted").alias("colour"))


@query(f"with {A} select user_id, id, application_date, rn from (select *, cast(row_number() over (partition by user_id order by application_date desc, id) as int) rn from apps) where rn <= 5")
def recent_5(spark, d):
    apps = x.applications(spark, d)
    return rows.top_per(apps, "user_id", rows.newest(apps, "application_date", "id"), 5).select("user_id", "id", "application_date", "rn")


@query(f"with {A} select id, user_id, application_date from apps order by application_date desc, id limit 5")
def recent_5_overall(spark, d):
    apps = x.applications(spark, d)
    return rows.select_rows(apps, ["id", "user_id", "application_date"], order=rows.newest(apps, "application_date", "id"), limit=5)


@query(f"with {T} select id, due_date from tasks order by due_date desc nulls first, id limit 20")
def tasks_newest(spark, d):
    t = x.tasks(spark, d)
    return rows.select_rows(t, ["id", "due_date"], order=rows.newest(t, "due_date", "id"), limit=20)


@query(f"with {R} select application_id, round_number, part, supplier, cast(row_number() over (partition by application_id order by round_number, part, supplier) as int) pos from rounds")
def rounds_ordered(spark, d):
    pos = F.row_number().over(W.partitionBy("application_id").orderBy("round_number", "part", "supplier"))
    return x.rounds(spark, d).select("application_id", "round_number", "part", "supplier", pos.alias("pos"))


# ---- aggregates -------------------------------------------------------------------------------------------------------


@query(f"with {A} select user_id, count(*) total from apps group by 1")
def kpi_totals(spark, d):
    return x.applications(spark, d).groupBy("user_id").agg(F.count("*").alias("total"))


@query(f"with {A} select user_id, status, count(*) cnt from apps group by 1, 2")
def status_breakdown(spark, d):
    return agg.status_breakdown(x.applications(spark, d))


@query(f"with {A} select user_id, application_date \"day\", count(*) n from apps group by 1, 2")
def daily_counts(spark, d):
    return agg.daily_counts(x.applications(spark, d), "application_date")


@query(f"with {A} select user_id, cast(date_trunc('week', application_date) as date) wk, count(*) n from apps group by 1, 2")
def weekly_counts(spark, d):
    return agg.weekly_counts(agg.daily_counts(x.applications(spark, d), "application_date"))


@query(f"""with {A} select user_id, count(*) filter (application_date between date '2001-03-25' and date '2001-03-31') last_7, count(*) filter (application_date between date '2001-03-18' and date '2001-03-24') prev_7,
count(*) filter (application_date = date '2001-03-31') today, count(*) filter (application_date = date '2001-03-30') yesterday,
count(*) filter (application_date between date '2001-03-01' and date '2001-03-31') "month", count(*) filter (application_date between date '2001-02-01' and date '2001-02-28') prev_month from apps group by 1""")
def kpi_windows(spark, d):
    return agg.window_counts(x.applications(spark, d), "application_date", dates.date_windows(F.lit(CLAMP_DAY).cast("date")))


@query(f"""with {A}, {R}, s as (select user_id, count(*) filter (status = 'Applied') applied, count(*) filter (status = 'Interview Scheduled') interview_scheduled,
count(*) filter (status = 'Interview Completed') interview_completed, count(*) filter (status = 'Offer Received') offer_received, count(*) filter (status = 'Rejected') rejected,
count(*) filter (status = 'Withdrawn') withdrawn from apps group by 1), f as (select user_id, count(distinct application_id) n from rounds where result = 'Failed' group by 1)
select s.*, coalesce(n, 0) rejected_after_interview, applied + interview_scheduled + interview_completed + offer_received + rejected + withdrawn + coalesce(n, 0) flow_total from s left join f using (user_id)""")
def flow(spark, d):
    return agg.stage_flow(x.applications(spark, d), x.rounds(spark, d))


@query(f"""with {A}, w as (select user_id, cast(date_trunc('week', application_date) as date) wk, count(*) n from apps group by 1, 2),
r as (select *, row_number() over (partition by user_id order by wk desc) rn, row_number() over (partition by user_id order by n desc, wk) b from w),
m as (select user_id, max(wk) filter (b = 1) best_week, max(n) filter (b = 1) best_n, avg(n) filter (rn <= 8) recent_mean from r group by 1)
select *, {pct('best_n', 'recent_mean')} change from m""")
def best_week(spark, d):
    return agg.weekly_profile(agg.daily_counts(x.applications(spark, d), "application_date"))


@query(f"""with {A}, g as (select user_id, count(*) total, count(*) filter (status = 'Applied') applied, count(*) filter (status in ('Rejected', 'Withdrawn')) dropped,
count(*) filter (application_date <= date '2001-07-18') old, count(*) filter (application_date <= date '2001-07-18' and status = 'Applied') silent,
count(*) filter (application_date between date '2001-07-04' and date '2001-07-17') before, count(*) filter (application_date between date '2001-07-04' and date '2001-07-17' and status = 'Applied') sb from apps group by 1),
r as (select user_id, total, {ratio('(total - applied)', 'total')} response_rate, {ratio('dropped', 'total')} drop_off_rate, {ratio('silent', 'old')} silence_rate, {ratio('sb', 'before')} silence_before from g)
select *, {pct('silence_rate', 'silence_before')} silence_change from r""")
def rates(spark, d):
    return agg.rates(x.applications(spark, d), day())


@query(f"""with {A}, c as (select user_id, status, count(*) cnt, list_position(['Applied', 'Interview Scheduled', 'Interview Completed', 'Offer Received', 'Rejected', 'Withdrawn'], status) o from apps group by 1, 2),
r as (select *, row_number() over (partition by user_id order by cnt desc, o) rn, sum(cnt) over (partition by user_id) total, sum(case when status in ('Rejected', 'Withdrawn') then cnt else 0 end) over (partition by user_id) dropped from c)
select user_id, status top_status, cnt top_count, cast(total as bigint) total, {ratio('dropped', 'total')} drop_off_rate from r where rn = 1""")
def top_status(spark, d):
    return agg.status_insights(agg.status_breakdown(x.applications(spark, d)))


# ---- series and windows -----------------------------------------------------------------------------------------------

_SPINE = f"""{T}, c as (select user_id, cast(created_at as date) "day", count(*) n from tasks group by 1, 2),
s as (select user_id, cast(g as date) "day" from (select distinct user_id from c), generate_series(date '{TASKS_DAY}' - {{k}}, date '{TASKS_DAY}', interval 1 day) t(g)),
j as (select user_id, "day", coalesce(n, 0) n from s left join c using (user_id, "day"))"""


@query(f"with {_SPINE.format(k=13)} select * from j")
def daily_spine(spark, d):
    return agg.with_spine(agg.daily_counts(x.tasks(spark, d), "created_at"), tasks_day(), 14)


@query(f"with {_SPINE.format(k=13)} select *, cast(sum(n) over (partition by user_id order by \"day\") as bigint) cumulative from j")
def cumulative_14d(spark, d):
    return agg.cumulative(agg.with_spine(agg.daily_counts(x.tasks(spark, d), "created_at"), tasks_day(), 14))


@query(f"""with {A}, c as (select user_id, application_date "day", count(*) n from apps group by 1, 2), u as (select user_id, coalesce(sum(n) filter ("day" < date '{APPS_DAY}' - 29), 0) seed from c group by 1),
s as (select user_id, seed, cast(g as date) "day" from u, generate_series(date '{APPS_DAY}' - 29, date '{APPS_DAY}', interval 1 day) t(g))
select user_id, "day", coalesce(n, 0) n, cast(seed + sum(coalesce(n, 0)) over (partition by user_id order by "day") as bigint) cumulative from s left join c using (user_id, "day")""")
def timeseries_30d(spark, d):
    return agg.timeseries(x.applications(spark, d), day(), 30)


@query(f"""with {T}, c as (select user_id, cast(created_at as date) "day", count(*) n from tasks group by 1, 2), m as (select *, row_number() over (partition by user_id order by "day" desc) - 1 b from c where n >= 2 and "day" <= date '{TASKS_DAY}')
select user_id, count(*) streak from m where date '{TASKS_DAY}' - "day" = b group by 1""")
def streak(spark, d):
    return agg.streak(agg.daily_counts(x.tasks(spark, d), "created_at"), tasks_day(), F.lit(2))


@query(f"with {_SPINE.format(k=13)}, t as (select user_id, list(n order by \"day\") v from j group by 1) select user_id, [32.0::double - (z - list_min(v)) / (case when list_max(v) = list_min(v) then 1 else list_max(v) - list_min(v) end)::double * 32.0::double for z in v] points from t")
def sparkline_norm(spark, d):
    trend = agg.sparkline(agg.with_spine(agg.daily_counts(x.tasks(spark, d), "created_at"), tasks_day(), 14))
    return trend.select("user_id", numbers.normalised(F.col("trend")).alias("points"))


def _kpis(spark, d):
    return kpi.kpi_table(x.applications(spark, d), x.tasks(spark, d), x.tenant_rounds(spark, d), x.profiles(spark, d), day(), now())


def _kpi_sql() -> str:
    day = f"date '{APPS_DAY}'"
    trend = lambda t: f"(select list(coalesce(n, 0) order by g) from (select cast(unnest(generate_series({day} - 13, {day}, interval 1 day)) as date) g) left join {t} on {t}.user_id = b.user_id and \"day\" = g)"
    between = lambda lo, hi: f"coalesce(sum(n) filter (\"day\" between {lo} and {hi}), 0)"
    half = lambda v, lo, hi: f"list_sum({v}[{lo}:{hi}])"
    rows_ = [
        ("total-applications", "total", "total::varchar", "'Applications submitted'", "velocity", "null", "[list_sum(trend[1:i]) for i in range(1, 15)]"),
        ("pending-tasks", "pending", "pending::varchar", "'Tasks to complete'", pct(half("tt", 8, 14), half("tt", 1, 7)), "null", "tt"),
        ("upcoming-interviews", "upcoming", "upcoming::varchar", "'Scheduled interviews'", pct(half("rt", 8, 14), half("rt", 1, 7)), "null", "rt"),
        ("monthly-goal", "m", "m || '/200'", "'Month-to-date progress'", pct("m", "pm"), "least(m / 200, 1.0)", "trend"),
        ("daily-goal", "td", "td || '/10'", "'Today'", pct("td", "yd"), "least(td / 10, 1.0)", "trend"),
        ("velocity-change", "velocity", "velocity || '%'", "'vs last week'", "velocity", "null", "trend"),
        ("application-streak", "0", "'0 days'", "'Days meeting daily goal'", "0", "null", "trend"),
        ("silence-rate", "silence", "silence || '%'", "'No response after 14 days'", pct("silence", "sbr"), "null", "trend"),
        ("most-productive-week", "bn", "case when bn > 0 then bn || ' apps' else 'No data' end", "case when bw is not null then 'Week of ' || bw else 'No activity yet' end", "case when bn > 0 then " + pct("bn", "rm") + " else 0 end", "null", "trend"),
        ("current-momentum", "l7 / 7", "replace(printf('%.1f', l7 / 7), ',', '') || '/day'", "'7-day average'", pct("(l7 / 7)", "(p7 / 7)"), "null", "trend"),
    ]
    titles = ["Total Applications", "Pending Tasks", "Upcoming Interviews", "Monthly Application Goal", "Daily Application Goal", "Application Velocity Change", "Application Streak", "Silence Rate",
              "Most Productive Week", "Current Momentum"]
    union = " union all ".join(
        f"select user_id, cast({k} as int) ord, '{i}' id, '{t_}' title, cast({n} as double) value_num, {t} value_text, {de} description, cast({c} as bigint) change_pct, cast({p} as double) progress, [cast(v as bigint) for v in {tr}] trend from z"
        for k, ((i, n, t, de, c, p, tr), t_) in enumerate(zip(rows_, titles), 1))
    return f"""with {A}, {R}, {T}, {P}, c as (select user_id, application_date "day", count(*) n, count(*) filter (status = 'Applied') a from apps group by 1, 2),
tc as (select user_id, cast(created_at as date) "day", count(*) n from tasks group by 1, 2), rc as (select user_id, cast(scheduled_date as date) "day", count(*) n from rounds group by 1, 2),
w as (select user_id, cast(date_trunc('week', "day") as date) wk, sum(n) n from c group by 1, 2), wr as (select *, row_number() over (partition by user_id order by wk desc) rn, row_number() over (partition by user_id order by n desc, wk) bb from w),
wk as (select user_id, max(wk) filter (bb = 1) bw, max(n) filter (bb = 1) bn, avg(n) filter (rn <= 8) rm from wr group by 1),
s as (select user_id, sum(n) total, {between(f'{day} - 6', day)} l7, {between(f'{day} - 13', f'{day} - 7')} p7, {between(day, day)} td, {between(f'{day} - 1', f'{day} - 1')} yd,
  {between("date '2001-08-01'", day)} m, {between("date '2001-07-01'", "date '2001-07-01'")} pm, coalesce(sum(n) filter ("day" <= {day} - 14), 0) old, coalesce(sum(a) filter ("day" <= {day} - 14), 0) silent,
  {between(f'{day} - 28', f'{day} - 15')} bf, coalesce(sum(a) filter ("day" between {day} - 28 and {day} - 15), 0) sb from c group by 1),
b as (select id user_id, {', '.join(f'coalesce({v}, 0) {v}' for v in ('total', 'l7', 'p7', 'td', 'yd', 'm', 'pm', 'old', 'silent', 'bf', 'sb'))}, bw, coalesce(bn, 0) bn, rm,
  coalesce((select count(*) from tasks t where t.user_id = profiles.id and status = 'Pending'), 0) pending, coalesce((select count(*) from rounds r where r.user_id = profiles.id and scheduled_date >= timestamp '{NOW}'), 0) upcoming
  from profiles left join s on s.user_id = id left join wk on wk.user_id = id),
z as (select *, {pct('l7', 'p7')} velocity, {ratio('silent', 'old')} silence, {ratio('sb', 'bf')} sbr, {trend('c')} trend, {trend('tc')} tt, {trend('rc')} rt from b)
{union}"""


@query(_kpi_sql())
def kpi_table(spark, d):
    return _kpis(spark, d)


_MEMBERS = ["ord", "id", "title", "value", "description", "change_pct", "progress", "trend"]


@query("select user_id, '[' || string_agg('{' || array_to_string(list_filter([" + ", ".join(
    f"'\"{m}\":' || cast(to_json({'value_text' if m == 'value' else m}) as varchar)" + (" " if m != "progress" else " ") for m in _MEMBERS)
    + f"], lambda v: v is not null and not contains(v, '\"progress\":null')), ',') || '}}', ',' order by ord) || ']' body from ({_kpi_sql()}) group by 1")
def kpi_json(spark, d):
    return kpi.kpi_json(_kpis(spark, d))


@query(f"""with {T}, c as (select user_id, cast(created_at as date) "day", count(*) n from tasks group by 1, 2),
p as (select user_id, 1 + user_id % 3 goal, case when user_id % 4 <> 0 then (user_id % 5) * 10 end mg from (select distinct user_id from c)),
k as (select a.d, c.user_id, "day", row_number() over (partition by a.d, c.user_id order by "day" desc) - 1 b from c join p using (user_id), (values (date '{TASKS_DAY}'), (date '{TASKS_DAY}' - 1)) a(d) where n >= goal and "day" <= a.d),
s as (select user_id, count(*) filter (d = date '{TASKS_DAY}' and d - "day" = b) now_, count(*) filter (d = date '{TASKS_DAY}' - 1 and d - "day" = b) before_ from k group by 1),
g as (select p.user_id, goal, coalesce(mg, 200) mg, coalesce(now_, 0) st, coalesce(before_, 0) sb, coalesce((select n from c where c.user_id = p.user_id and "day" = date '{TASKS_DAY}'), 0) td,
  coalesce((select n from c where c.user_id = p.user_id and "day" = date '{TASKS_DAY}' - 1), 0) yd,
  coalesce((select sum(n) from c where c.user_id = p.user_id and "day" between date '2024-01-01' and date '{TASKS_DAY}'), 0) m,
  coalesce((select sum(n) from c where c.user_id = p.user_id and "day" between date '2023-12-01' and date '2023-12-30'), 0) pm from p left join s using (user_id))
select user_id, 'application-streak' id, st || ' days' value_text, {pct('st', 'sb')} change_pct, cast(null as double) progress from g
union all select user_id, 'daily-goal', td || '/' || goal, {pct('td', 'yd')}, least(td / goal, 1.0) from g
union all select user_id, 'monthly-goal', case when mg > 0 then m || '/' || mg else 'Set a goal' end, {pct('m', 'pm')}, case when mg > 0 then least(m / mg, 1.0) else 0 end from g""")
def kpi_goals(spark, d):
    """Streaks and goals of tenants who set goals and meet them: the indicators over the daily tasks."""
    t = x.tasks(spark, d)
    apps = t.select("id", "user_id", F.col("created_at").cast("date").alias("application_date"), F.lit("Applied").alias("status"))
    own = t.select(F.col("user_id").alias("id")).distinct()
    own = own.withColumns({"daily_application_goal": 1 + F.col("id") % 3, "monthly_application_goal": F.when(F.col("id") % 4 != 0, (F.col("id") % 5) * 10)})
    rounds_ = t.select("user_id", F.col("created_at").alias("scheduled_date"))
    out = kpi.kpi_table(apps, t, rounds_, own, tasks_day(), F.expr(f"timestamp_ntz'{TASKS_DAY} 00:00:00'"))
    return out.filter(F.col("id").isin("application-streak", "daily-goal", "monthly-goal")).select("user_id", "id", "value_text", "change_pct", "progress")


# ---- joins and sets ---------------------------------------------------------------------------------------------------


@query(f"with {R} select r.user_id, application_id, round_number, part, supplier, lead from rounds r, (values (24), (48)) l(lead) where scheduled_date >= timestamp '{NOW}' + to_hours(lead - 1) and scheduled_date < timestamp '{NOW}' + to_hours(lead + 1) and sent is null")
def reminder_leads(spark, d):
    return reminders.due_rounds(x.tenant_rounds(spark, d), now()).select("user_id", "application_id", "round_number", "part", "supplier", "lead")


@query(f"with {R} select application_id, round_number, part, supplier, scheduled_date from rounds where scheduled_date >= timestamp '{NOW}' + to_hours(23) and scheduled_date < timestamp '{NOW}' + to_hours(25) and sent is null order by application_id, round_number, part, supplier limit 50")
def reminder_window(spark, d):
    keys = ["application_id", "round_number", "part", "supplier"]
    due = reminders.due_rounds(x.rounds(spark, d), now(), leads=(24,))
    return reminders.capped(due, [F.col(k) for k in keys]).select(*keys, "scheduled_date")


@query(f"with {R}, {P} select distinct user_id, email from rounds join profiles on user_id = id where scheduled_date >= timestamp '{NOW}' and scheduled_date < timestamp '{NOW}' + to_hours(49) and coalesce(interview_reminders_enabled, true) and email is not null")
def reminder_profiles(spark, d):
    due = x.tenant_rounds(spark, d).filter((F.col("scheduled_date") >= now()) & (F.col("scheduled_date") < F.timestamp_add("HOUR", F.lit(49), now()))).select("user_id").distinct()
    p = x.profiles(spark, d).filter(F.col("email").isNotNull() & reminders.wants_reminder(F.col("interview_reminders_enabled")))
    return p.join(due, F.col("id") == F.col("user_id"), "left_semi").select(F.col("id").alias("user_id"), "email")


_OUTBOX = f"""{R}, {P}, d as (select r.*, lead from rounds r, (values (24), (48)) l(lead) where scheduled_date >= timestamp '{NOW}' + to_hours(lead - 1) and scheduled_date < timestamp '{NOW}' + to_hours(lead + 1) and sent is null),
k as (select *, row_number() over (partition by lead order by application_id, round_number, part, supplier) rn from d),
o as (select k.*, email, case when user_id % 3 <> 0 then full_name end company from k join profiles on user_id = id where rn <= 50 and coalesce(interview_reminders_enabled, true) and email is not null)"""


def _outbox(spark, d):
    keys = ["application_id", "round_number", "part", "supplier"]
    named = x.companies(spark, d).filter(F.pmod("user_id", F.lit(3)) != 0)
    apps = x.applications(spark, d).join(named, "user_id").select(F.col("id").alias("application_id"), "user_id", "company_name")
    return reminders.reminder_outbox(x.tenant_rounds(spark, d), x.profiles(spark, d), apps, now(), [F.col(k) for k in keys]), keys


@query(f"""with {_OUTBOX} select application_id, round_number, part, supplier, lead, email "to", 'Interview reminder: ' || coalesce(company, 'your interview') || ' in ' || lead || ' hours' subject,
'Reminder: your interview with ' || coalesce(company, 'your interview') || ' is scheduled for ' || strftime(scheduled_date, '%Y-%m-%dT%H:%M:%S.%gZ') || ' (in ' || lead || ' hours).' "text" from o""")
def reminder_outbox(spark, d):
    box, keys = _outbox(spark, d)
    return box.select(*keys, "lead", "to", "subject", "text")


@query(f"""with {A}, {P} select apps.id, email "to", 'Application saved for ' || c_name subject, 'Your application for ' || position_title || ' at ' || c_name || ' was saved in Tally.' "text"
from apps join profiles on user_id = profiles.id join customer on c_custkey = user_id where email is not null and coalesce(user_id % 6 <> 1, true)""")
def application_outbox(spark, d):
    apps = x.applications(spark, d).join(x.companies(spark, d), "user_id")
    who = x.profiles(spark, d).withColumn("application_updates_enabled", F.when(F.col("id") % 6 == 1, False))
    return reminders.application_outbox(apps, who, "Tally").select("id", "to", "subject", "text")


@query(f"""with {R}, {P}, {A}, o as (select r.*, email, case when r.user_id % 3 <> 0 then full_name end company from rounds r join profiles on r.user_id = profiles.id
  where part % 10 <> 0 and coalesce(interview_reminders_enabled, true) and email is not null)
select application_id, round_number, part, supplier, email "to", 'Interview scheduled with ' || coalesce(company, 'your interview') subject,
'Your interview with ' || coalesce(company, 'your interview') || ' is scheduled for ' || strftime(scheduled_date, '%Y-%m-%dT%H:%M:%S.%gZ') || '. We''ll remind you ahead of time.' "text" from o""")
def interview_outbox(spark, d):
    named = x.companies(spark, d).filter(F.pmod("user_id", F.lit(3)) != 0)
    apps = x.applications(spark, d).join(named, "user_id").select(F.col("id").alias("application_id"), "user_id", "company_name")
    r = x.tenant_rounds(spark, d).withColumn("scheduled_date", F.when(F.pmod("part", F.lit(10)) != 0, F.col("scheduled_date")))
    return reminders.interview_outbox(r, x.profiles(spark, d), apps).select("application_id", "round_number", "part", "supplier", "to", "subject", "text")


@query(f"""with {_OUTBOX}, h as (select distinct application_id, round_number, part, supplier from o where lead = 24)
select r.application_id, r.round_number, r.part, r.supplier, coalesce(sent, case when h.part is not null then '{NOW}' end) sent from rounds r left join h using (application_id, round_number, part, supplier)""")
def stamp_sent(spark, d):
    box, keys = _outbox(spark, d)
    return reminders.stamp_sent(x.rounds(spark, d), box.filter("lead = 24"), keys, "sent", F.lit(NOW)).select(*keys, "sent")


_EVENTS = f"""{R}, {C}, {T}, {D}, e as (
select application_id, 'interview' "type", round_number || '.' || part || '.' || supplier id, interview_type || ' Interview - Round ' || round_number title, null description, scheduled_date "at", result status from rounds
union all select application_id, 'contact', id::varchar, 'Added contact: ' || "name", case when "position" is not null then case when company is not null then "position" || ' at ' || company else "position" end else company end, created_at, null from contacts
union all select id, 'task', id::varchar, title, null, coalesce(due_date::timestamp, created_at), status from tasks
union all select application_id, 'document', id::varchar, 'Uploaded: ' || filename, null, uploaded_at, null from docs)"""


@query(f"with {_EVENTS} select *, cast(row_number() over (partition by application_id order by \"at\" desc, \"type\", id, title) as int) pos from e")
def timeline(spark, d):
    r = x.rounds(spark, d).withColumn("id", F.concat_ws(".", "round_number", "part", "supplier"))
    t = x.tasks(spark, d).withColumn("application_id", F.col("id"))
    pos = F.row_number().over(W.partitionBy("application_id").orderBy(F.desc("at"), "type", "id", "title"))
    return tl.timeline(r, x.contacts(spark, d), t, x.documents(spark, d)).withColumn("pos", pos)


_CAL = f"""{T}, {R}, {P}, i as (select user_id, 'Task' "type", tasks.id::varchar id, title, (timezone(z, timezone('UTC', due_date::timestamp + interval 12 hours))) "at"
  from tasks join (select id pid, coalesce(nullif(time_zone, ''), 'America/New_York') z from profiles) on pid = user_id where status = 'Pending' and due_date is not null
union all select user_id, 'Interview', application_id || '.' || round_number || '.' || part || '.' || supplier, 'Interview · ' || interview_type, timezone(z, timezone('UTC', scheduled_date))
  from rounds join (select id pid, coalesce(nullif(time_zone, ''), 'America/New_York') z from profiles) on pid = user_id)"""


def _calendar(spark, d, anchor):
    p = x.profiles(spark, d).withColumn("time_zone", dates.zone_or_default(F.col("time_zone")))
    r = x.tenant_rounds(spark, d).withColumn("id", F.concat_ws(".", "application_id", "round_number", "part", "supplier"))
    return tl.calendar_items(x.tasks(spark, d), r, p, F.lit(anchor).cast("date"))


@query(f"with {_CAL} select user_id, \"type\", id, title, \"at\", cast(\"at\" as date) \"day\" from i where cast(\"at\" as date) between date '2001-05-28' and date '2001-06-10'")
def calendar_items(spark, d):
    return _calendar(spark, d, "2001-06-02")


@query(f"with {_CAL} select user_id, cast(\"at\" as date) \"day\", count(*) n, list(\"type\" || ' ' || id || ' ' || title order by \"at\", \"type\", id, title) items from i where cast(\"at\" as date) between date '2024-01-15' and date '2024-01-28' group by 1, 2")
def calendar_days(spark, d):
    return tl.calendar(_calendar(spark, d, "2024-01-17"))


@query(f"with {A} select id, status from apps where id in (select p_partkey * 3 from part)")
def selection_semi(spark, d):
    chosen = x.table(spark, d, "part").select((F.col("p_partkey") * 3).alias("id"))
    return x.applications(spark, d).join(chosen, "id", "left_semi").select("id", "status")


@query(f"""with {A}, h as (select user_id, case when user_id % 2 = 0 then ['notes'] else ['company name', 'notes'] end || case when user_id % 3 = 0 then [] else ['position title'] end || ['status'] have from (select distinct user_id from apps))
select user_id, 'Missing required columns: ' || array_to_string(list_filter(['company name', 'position title', 'application date', 'status'], lambda c: not list_contains(have, c)), ', ') message from h""")
def missing_columns(spark, d):
    """The header that a tenant's file begins with, against the columns that an import needs."""
    e = _export(spark, d)
    titles = [F.when(F.col("user_id") % 2 != 0, F.lit("Company Name")), F.lit(" notes"), F.when(F.col("user_id") % 3 != 0, F.lit('"POSITION title"')), F.lit("Status")]
    head = e.select("user_id").distinct().select(F.concat_ws(",", *titles).alias("value"), F.lit(-1).cast("long").alias("at"), "user_id")
    lines = head.unionByName(e.select(csvio.csv_line(e).alias("value"), F.col("id").alias("at"), "user_id"))
    return csvio.parse_applications(lines, order=F.col("at"), file="user_id")[1].select(F.col("file").alias("user_id"), "message")


_FRAMES = ", ".join(f"cast(coalesce(sum(n) over (partition by user_id order by day range between interval {k - 1} days preceding and current row), 0) as bigint) last_{k}, "
                    f"cast(coalesce(sum(n) over (partition by user_id order by day range between interval {2 * k - 1} days preceding and interval {k} days preceding), 0) as bigint) prior_{k}" for k in (7, 14, 30))


@query(f"""with {T}, c as (select user_id, cast(created_at as date) as "day", count(*) n from tasks group by 1, 2),
s as (select user_id, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as "day" from c group by 1),
f as (select s.user_id, s.day, coalesce(n, 0) n from s left join c on c.user_id = s.user_id and c.day = s.day),
w as (select user_id, day, n, {_FRAMES} from f)
select *, {pct("last_7", "prior_7")} change_7, {pct("last_14", "prior_14")} change_14, {pct("last_30", "prior_30")} change_30 from w""")
def trailing_frames(spark, d):
    """Trailing 7, 14 and 30 days of tasks against those before, for every day of every tenant."""
    return agg.trailing_frames(agg.daily_counts(x.tasks(spark, d), "created_at"))


# ---- changes and rules ------------------------------------------------------------------------------------------------


@query(f"""with {A} select id, case when id % 4 = 0 then null when id % 4 = 1 then 'moved' else position_title end position_title, case when id % 4 = 1 then 'Rejected' else status end status from apps""")
def updates_to_null(spark, d):
    """A change sets what it gives, null too, and nothing else."""
    apps = x.applications(spark, d).select("id", "position_title", "status")
    m = F.pmod("id", F.lit(4))
    new = apps.filter(m <= 1).select("id", F.when(m == 1, "moved").alias("position_title"), F.lit("Rejected").alias("status"), F.when(m == 1, F.array(F.lit("position_title"), F.lit("status"))).otherwise(F.array(F.lit("position_title"))).alias("given"))
    return changes.apply_updates(apps, new, ["id"], given="given")


@query(f"with {A}, {R} select application_id, round_number, part, supplier from rounds where application_id not in (select id from apps where status = 'Withdrawn')")
def cascade_anti(spark, d):
    apps = x.applications(spark, d)
    return changes.delete_cascade(apps, [x.rounds(spark, d)], apps.filter("status = 'Withdrawn'"), "id", "application_id")[1][0].select("application_id", "round_number", "part", "supplier")


@query(f"""with {P}, {A}, {R}, {T}, {C}, {D}, gone as (select id from profiles where id % 5 = 0), a as (select id from apps where user_id in (select id from gone)),
t as (select id, user_id, case when id % 3 <> 0 then id end application_id from tasks)
select 'profiles' tbl, cast(id as varchar) k from profiles where id not in (select id from gone)
union all select 'applications', cast(id as varchar) from apps where id not in (select id from a)
union all select 'interview_rounds', application_id || '-' || round_number || '-' || part || '-' || supplier from rounds where application_id not in (select id from a)
union all select 'contacts', cast(id as varchar) from contacts where application_id not in (select id from a)
union all select 'tasks', cast(id as varchar) from t where user_id not in (select id from gone) and coalesce(application_id not in (select id from a), true)
union all select 'documents', cast(id as varchar) from docs where application_id not in (select id from a)""")
def cascade_profiles(spark, d):
    """Every fifth profile is deleted: its applications go, and with these or with it all rounds, contacts, tasks and documents."""
    rows = x.sizes(spark, d)
    tables = x.domain(spark, d, rows)
    left = changes.cascade(tables, x.FOREIGN_KEYS, {"profiles": tables["profiles"].filter("id % 5 = 0").select("id")}, rows)
    shown = [df.select(F.lit(t).alias("tbl"), (F.concat_ws("-", "application_id", "round_number", "part", "supplier") if t == "interview_rounds" else F.col("id").cast("string")).alias("k")) for t, df in left.items()]
    return reduce(DataFrame.unionByName, shown)


@query(f"with {P} select id, full_name from profiles where id % 2 = 0 union all select id, 'New ' || full_name from profiles where id % 2 <> 0 and id % 3 = 0")
def insert_if_absent(spark, d):
    p = x.profiles(spark, d).select("id", "full_name")
    new = p.filter("id % 3 = 0").withColumn("full_name", F.concat(F.lit("New "), F.col("full_name")))
    return changes.insert_if_absent(p.filter("id % 2 = 0"), new, "id")


@query(f"with {A} select id, case when id % 5 = 0 then 'Withdrawn' else status end status from apps")
def bulk_update(spark, d):
    return changes.set_where(x.applications(spark, d), F.pmod("id", F.lit(5)) == 0, {"status": F.lit("Withdrawn")}).select("id", "status")


@query(f"""with {T} select count(*) filter (where status = 'Pending' and due_date is not null) written, count(*) filter (where not (status = 'Pending' and due_date is not null)) failed,
min(case when status <> 'Pending' then 'task ' || id || ' is ' || status when due_date is null then 'task ' || id || ' has no date' end) first_problem from tasks""")
def bulk_update_counted(spark, d):
    """All tasks are completed at once; those that are not pending or have no date fail, and are counted as the others are written."""
    t = x.tasks(spark, d).select("id", "status", "due_date")
    pending = F.col("status") == "Pending"
    problem = F.concat(F.lit("task "), F.col("id").cast("string"), F.when(pending, " has no date").otherwise(F.concat(F.lit(" is "), F.col("status"))))
    path = folders.fresh_folder(spark, "completed")
    return changes.counted_write(t, pending & F.col("due_date").isNotNull(), lambda good: good.withColumn("status", F.lit("Completed")).write.parquet(path), problem)


@query(f"""with {A}, n as (select -id - 1 id, user_id, case when id % 7 = 0 then user_id + 1 when id % 11 = 0 then null else user_id end asker from apps)
select id, user_id, case when asker = user_id then null else 'new row violates row-level security policy for table applications' end error from n""")
def policy_insert(spark, d):
    """Every tenant copies its applications; some are asked for by another tenant, or by nobody."""
    asker = F.when(F.col("id") % 7 == 0, F.col("user_id") + 1).when(F.col("id") % 11 != 0, F.col("user_id"))
    new = x.applications(spark, d).select((-F.col("id") - 1).alias("id"), "user_id", asker.alias("asker"))
    good, bad = changes.checked_insert(new, "applications", F.col("asker"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("id", "user_id", "error")


@query(f"""with {A} select id, user_id, case when id % 4 = 0 and id % 3 <> 0 and id % 8 <> 0 then 'Rejected' else status end status from apps
union all select id, user_id + 1, 'refused' from apps where id % 8 = 0 and id % 3 <> 0""")
def policy_update(spark, d):
    """Every fourth application is rejected; a third of these changes comes from a stranger, and half would give the row away."""
    apps = x.applications(spark, d).select("id", "user_id", "status")
    asked = apps.filter("id % 4 = 0").select(
        "id", F.when(F.col("id") % 8 == 0, F.col("user_id") + 1).alias("user_id"), F.lit("Rejected").alias("status"), (F.col("user_id") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("asker"))
    after, refused = changes.checked_update(apps, asked, "applications", ["id"], "asker")
    return after.unionByName(refused.select("id", "user_id", F.lit("refused").alias("status")))


@query(f"with {A} select id, user_id from apps where not (id % 4 = 0 and id % 3 <> 0)")
def policy_delete(spark, d):
    apps = x.applications(spark, d).select("id", "user_id")
    asked = apps.filter("id % 4 = 0").select("id", (F.col("user_id") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("asker"))
    return changes.checked_delete(apps, asked, "applications", ["id"], "asker")


@query(f"with {A} select id, user_id, case when id % 100 = 0 then 'Withdrawn' else status end status from apps where id % 100 <> 50")
def update_in_place(spark, d):
    """A stored table of which only the folders of touched tenants are rewritten: some rows change, some go."""
    path = folders.fresh_folder(spark, "applications")
    apps = x.applications(spark, d).select("id", "user_id", "status")
    stored.write_by_tenant(apps, path)

    def change(mine, asked):
        return changes.delete_rows(changes.apply_updates(mine, asked.filter("id % 100 = 0").select("id", "status"), ["id"]), asked.filter("id % 100 = 50"), "id")

    stored.update_by_tenant(spark, path, apps.filter("id % 50 = 0").withColumn("status", F.lit("Withdrawn")), change)
    return stored.read_by_tenant(spark, path)


@query(f"with {A} select id, cast(user_id % 3 as int) batch from apps")
def publish_batches(spark, d):
    """Three batches, each added whole and one of them asked for twice."""
    path = folders.fresh_folder(spark, "batches")
    apps = x.applications(spark, d).select("id", "user_id")
    for b in (0, 1, 2, 1):
        stored.publish_batch(apps.filter(F.col("user_id") % 3 == b).select("id"), path, str(b))
    return spark.read.parquet(path)


@query(f"with {A} select id, case when id % 4 = 0 then 'Rejected' else status end status, case when id % 4 = 0 then timestamp '{NOW}' else timestamp '2001-01-01' end updated_at from apps")
def apply_updates(spark, d):
    apps = x.applications(spark, d).select("id", "status").withColumn("updated_at", F.expr("timestamp_ntz'2001-01-01 00:00:00'"))
    new = apps.filter("id % 4 = 0").select("id", F.lit("Rejected").alias("status"))
    return changes.apply_updates(apps, new, ["id"], now())


@query(f"with {A} select id, status, timestamp '2001-01-01' created_at from apps union all select -id - 1, 'Applied', timestamp '{NOW}' from apps")
def append_rows(spark, d):
    apps = x.applications(spark, d).select("id", "status").withColumn("created_at", F.expr("timestamp_ntz'2001-01-01 00:00:00'"))
    return changes.append_rows(apps, apps.select((-F.col("id") - 1).alias("id"), F.lit("Applied").alias("status")), now())


@query(f"with {A} select id, status from apps where id % 7 <> 0")
def delete_rows(spark, d):
    apps = x.applications(spark, d)
    return changes.delete_rows(apps, apps.filter("id % 7 = 0"), "id").select("id", "status")


@query(f"with {P} select id, case when id = 5 then 'Renamed' else full_name end full_name from profiles")
def schema_aware_update(spark, d):
    p = x.profiles(spark, d).select("id", "full_name")
    return changes.schema_aware_update(p, F.col("id") == 5, {"full_name": F.lit("Renamed"), "daily_application_goal": F.lit(3)})


@query(f"with {P} select id, full_name, cast(null as int) daily_application_goal from profiles")
def add_missing_columns(spark, d):
    return changes.with_missing_columns(x.profiles(spark, d).select("id", "full_name"), {"daily_application_goal": "int", "full_name": "string"})


@query(f"""with {T}, t as (select id, case when id % 9 = 0 then '' else title end title, case when id % 11 = 0 then 'Urgent' else priority end priority, status from tasks)
select id, list_filter([case when title = '' then 'Title is required' end, case when priority = 'Urgent' then 'priority: must be one of Low, Medium, High, Critical' end], lambda m: m is not null) errors from t where id % 9 = 0 or id % 11 = 0""")
def validate_tasks(spark, d):
    t = x.tasks(spark, d).select("id", "status", F.lit(None).cast("string").alias("application_id"), F.when(F.col("id") % 9 == 0, "").otherwise(F.col("title")).alias("title"),
                                 F.when(F.col("id") % 11 == 0, "Urgent").otherwise(F.col("priority")).alias("priority"))
    return validation.split_valid(t, validation.task_rules())[1].select("id", "errors")


@query(f"with {P} select id, coalesce(interview_reminders_enabled, true) wants from profiles")
def reminder_preferences(spark, d):
    return x.profiles(spark, d).select("id", reminders.wants_reminder(F.col("interview_reminders_enabled")).alias("wants"))


@query(f"""with {P} select id, list_filter([case when id % 8 = 0 then 'Full name is required' end, case when id % 5 = 0 then 'monthly_application_goal: must be 0 or more' end], lambda m: m is not null) errors
from profiles where id % 8 = 0 or id % 5 = 0""")
def validate_profiles(spark, d):
    p = x.profiles(spark, d).select("id", F.when(F.col("id") % 8 == 0, "").otherwise(F.nullif("full_name", F.lit("nobody"))).alias("full_name"), F.when(F.col("id") % 5 == 0, -1).alias("monthly_application_goal"), F.lit(0).alias("daily_application_goal"))
    return validation.split_valid(p, validation.profile_rules())[1].select("id", "errors")


@query(f"""with {T} select id, list_filter([case when id % 9 = 0 and id % 2 = 0 then 'Title is required' end, case when id % 11 = 0 and id % 3 = 0 then 'priority: must be one of Low, Medium, High, Critical' end], lambda m: m is not null) errors
from tasks where id % 9 = 0 and id % 2 = 0 or id % 11 = 0 and id % 3 = 0""")
def validate_partial(spark, d):
    """A partial update is judged on the fields that it gives."""
    given = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, F.lit("title")), F.when(F.col("id") % 3 == 0, F.lit("priority"))))
    t = x.tasks(spark, d).select("id", F.lit(None).cast("string").alias("status"), F.lit("x").alias("application_id"), F.when(F.col("id") % 9 == 0, "").otherwise(F.col("title")).alias("title"),
                                 F.when(F.col("id") % 11 == 0, "Urgent").otherwise(F.col("priority")).alias("priority"), given.alias("given"))
    return validation.split_valid(t, validation.partial(validation.task_rules_by_column()))[1].select("id", "errors")


@query(f"""with {C}, v as (select id, case when id % 6 = 0 then '' else name end n, case when id % 4 = 0 then 'no address' when id % 4 = 1 then 'a b@x.org' when id % 4 = 2 then '' else lower(replace(name, '#', '.')) || '@example.com' end e, id % 5 u from contacts)
select id, list_filter([case when n = '' then 'Name is required' end, case when e in ('no address', 'a b@x.org') then 'Invalid email' end, case when u in (1, 2) then 'Invalid application ID' end], lambda m: m is not null) errors
from v where n = '' or e in ('no address', 'a b@x.org') or u in (1, 2)""")
def validate_contacts(spark, d):
    """Names, addresses and application ids of all contacts; a text that may be left out may be empty."""
    k, u = F.pmod("id", F.lit(4)), F.pmod("id", F.lit(5))
    email = F.when(k == 0, "no address").when(k == 1, "a b@x.org").when(k == 2, "").otherwise(F.concat(F.lower(F.replace("name", F.lit("#"), F.lit("."))), F.lit("@example.com")))
    key = F.lpad(F.col("id").cast("string"), 12, "0")
    uuid = F.when(u == 0, None).when(u == 1, key).when(u == 2, F.concat(F.lit("0000000g-0000-4000-8000-"), key)).when(u == 3, "").otherwise(F.concat(F.lit("0000000A-0000-4000-8000-"), key))
    c = x.contacts(spark, d).select("id", F.when(F.col("id") % 6 == 0, "").otherwise(F.col("name")).alias("name"), email.alias("email"), uuid.alias("application_id"))
    return validation.split_valid(c, validation.contact_rules())[1].select("id", "errors")


@query(f"""with {T}, v as (select id, case when id % 10 = 0 then null else title end t, case when id % 8 = 0 then 'Urgent' when id % 8 = 1 then null else priority end p, case when id % 6 = 0 then 'Done' when id % 6 = 1 then null else status end s, id % 9 = 0 u, due_date from tasks)
select id, due_date is null no_date, list_filter([case when t is null then 'Title is required' end, case when id % 8 in (0, 1) then 'priority: must be one of Low, Medium, High, Critical' end,
case when id % 6 in (0, 1) then 'status: must be one of Pending, In Progress, Completed, Cancelled' end, case when u then 'Invalid application ID' end], lambda m: m is not null) errors from v""")
def validate_tasks(spark, d):
    """All tasks with their errors; a task without a date is as good as another."""
    t = x.tasks(spark, d).select(
        "id", "due_date", F.when(F.col("id") % 10 != 0, F.col("title")).alias("title"), F.when(F.col("id") % 8 == 0, "Urgent").when(F.col("id") % 8 != 1, F.col("priority")).alias("priority"),
        F.when(F.col("id") % 6 == 0, "Done").when(F.col("id") % 6 != 1, F.col("status")).alias("status"), F.when(F.col("id") % 9 == 0, "x").alias("application_id"))
    return validation.validate(t, validation.task_rules()).select("id", F.col("due_date").isNull().alias("no_date"), "errors")


# ---- streams, replayed to the end ----------------------------------------------------------------------------------


def _events(spark, d):
    return replay.table_stream(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


_CLOSED = "(select max(ts) - interval 1 day from events)"


@query(f"""with days as (select user_id, cast(ts as date) "day", count(*) n from events group by 1, 2),
w as (select user_id, cast(unnest(generate_series(day, day + interval 13 day, interval 1 day)) as date) "day", n from days)
select user_id, day, cast(sum(n) as bigint) n from w where day + interval 1 day <= {_CLOSED} group by 1, 2""")
def stream_trailing_14d(spark, d):
    """Events of the 14 days up to each day that the stream's watermark has passed."""
    return replay.replayed(timers.trailing_activity(_events(spark, d), 14))


@query(f"""with days as (select user_id, cast(ts as date) "day", count(*) n from events group by 1, 2)
select user_id, day, n, cast(sum(n) over (partition by user_id, date_trunc('month', day) order by day) as bigint) month_to_date from days where day + interval 1 day <= {_CLOSED}""")
def stream_month_to_date(spark, d):
    with replay.state_store(spark):
        return replay.replayed(timers.month_to_date(_events(spark, d)))


_ROUND_ID = "((application_id * 10 + round_number) * 100000 + part) * 1000 + supplier"


@query(f"""with {R}, h as (select unnest([24, 48]) lead)
select {_ROUND_ID} round_id, cast(lead as int) "lead", cast(scheduled_date as timestamp) scheduled_date from rounds, h
where scheduled_date >= timestamp '{NOW}' + to_hours(lead - 1) and scheduled_date < timestamp '{NOW}' + to_hours(lead + 1)""")
def stream_reminder_timers(spark, d):
    """All rounds that are ahead, registered at one moment: those whose timers that moment sets off."""
    s = replay.table_stream(spark, f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("round_number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("timestamp").alias("scheduled_date"))
    moment = F.lit(NOW).cast("timestamp")
    ahead = s.filter(F.col("scheduled_date") > moment).select(F.expr(_ROUND_ID).alias("round_id"), moment.alias("seen_at"), "scheduled_date")
    with replay.state_store(spark):
        return replay.replayed(timers.reminder_timers(ahead)).withColumn("scheduled_date", F.col("scheduled_date").cast("timestamp_ntz"))


# ---- CSV, blobs, JSON -------------------------------------------------------------------------------------------------


def _export(spark, d):
    apps = x.applications(spark, d).join(x.companies(spark, d), "user_id")
    return apps.withColumn("notes", F.concat(F.lit('say "'), F.col("status"), F.lit('"'))).withColumn("company_name", F.concat(F.col("company_name"), F.lit(' "x", y')))


@query(f"""with {A} select id, '"' || replace(c_name || ' "x", y', '"', '""') || '","' || position_title || '",' || application_date || ',"' || status || '","","","","","say ""' || status || '""' || chr(34) line from apps join customer on user_id = c_custkey""")
def csv_export_lines(spark, d):
    e = _export(spark, d)
    return e.select("id", csvio.csv_line(e).alias("line"))


@query(f"""with {A} select id, '"' || c_name || ' "x", y","' || position_title || '",' || application_date || ',"' || status || '","","","","","say ""' || status || '""' || chr(34) line from apps join customer on user_id = c_custkey""")
def csv_export_compat(spark, d):
    e = _export(spark, d)
    return e.select("id", csvio.csv_line(e, compat=True).alias("line"))


@query(f"""with {A} select id, c_name || ' "x", y' company_name, position_title, cast(application_date as varchar) application_date, status, 'say "' || status || '"' notes from apps join customer on user_id = c_custkey""")
def csv_roundtrip(spark, d):
    e = _export(spark, d)
    names = list(csvio.HEADER.values())
    back = e.select("id", csvio.fields(csvio.csv_line(e)).alias("f")).select("id", *[F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return back.select("id", "company_name", "position_title", "application_date", "status", "notes")


@query(f"""with {A}, b as (select id, user_id, row_number() over (partition by user_id order by id) + 1 n, case when id % 13 = 0 then '' else position_title end p, case when id % 17 = 0 then 'Unknown' else status end s from apps)
select user_id, 'Row ' || n || ': ' || array_to_string(list_filter([case when p = '' then 'Position title is required' end, case when s = 'Unknown' then 'status: must be one of Applied, Interview Scheduled, Interview Completed, Offer Received, Rejected, Withdrawn' end], lambda m: m is not null), ', ') message
from b where p = '' or s = 'Unknown'""")
def csv_validate(spark, d):
    e = _export(spark, d)
    e = e.withColumn("position_title", F.when(F.col("id") % 13 == 0, "").otherwise(F.col("position_title"))).withColumn("status", F.when(F.col("id") % 17 == 0, "Unknown").otherwise(F.col("status")))
    head = e.select("user_id").distinct().select(F.lit(csvio.csv_header()).alias("value"), F.lit(-1).cast("long").alias("at"), "user_id")
    lines = head.unionByName(e.select(csvio.csv_line(e).alias("value"), F.col("id").alias("at"), "user_id"))
    return csvio.parse_applications(lines, order=F.col("at"), file="user_id")[1].select(F.col("file").alias("user_id"), "message")


@query(f"""with {A}, bad as (select distinct user_id from apps where id % 13 = 0), n as (select id, user_id, application_date, status, position_title from apps)
select id, user_id, application_date, status, position_title from n union all
select null, user_id, application_date, status, position_title from n where user_id not in (select user_id from bad)""")
def csv_import(spark, d):
    """Every tenant imports its own export; a file with a bad row is rejected whole."""
    apps = x.applications(spark, d)
    e = _export(spark, d).withColumn("position_title", F.when(F.col("id") % 13 == 0, "").otherwise(F.col("position_title")))
    head = e.select("user_id").distinct().select(F.lit(csvio.csv_header()).alias("value"), F.lit(-1).cast("long").alias("at"), "user_id")
    lines = head.unionByName(e.select(csvio.csv_line(e).alias("value"), F.col("id").alias("at"), "user_id"))
    good, _ = csvio.parse_applications(lines, order=F.col("at"), file="user_id")
    return csvio.import_applications(apps, good.withColumn("tenant", F.col("file")), F.col("tenant"))


_NOTES = "'line one of ' || position_title || chr(10) || chr(10) || '  \"' || status || '\", ' || chr(10) || id"


@query(f"""with {A} select user_id, row_number() over (partition by user_id order by id) + 1 n, c_name || ' "x", y' company_name, cast(application_date as varchar) application_date, status,
case when id % 3 = 0 then {_NOTES} else 'plain' end notes from apps join customer on user_id = c_custkey""")
def csv_multi_line(spark, d):
    """Every tenant imports its own export, whose notes hold newlines, from blocks of physical lines that cut records anywhere."""
    note = F.concat(F.lit("line one of "), F.col("position_title"), F.lit('\n\n  "'), F.col("status"), F.lit('", \n'), F.col("id").cast("string"))
    e = _export(spark, d).withColumn("notes", F.when(F.col("id") % 3 == 0, note).otherwise("plain"))
    head = e.select("user_id").distinct().select(F.lit(csvio.csv_header()).alias("record"), F.lit(-1).cast("long").alias("id"), "user_id")
    records = head.unionByName(e.select(csvio.csv_line(e).alias("record"), "id", "user_id"))
    lines = records.select("user_id", "id", F.posexplode(F.split("record", "\n")).alias("k", "value"))
    # 64 lines of the order of ids are a block, whatever record they belong to
    at = F.col("id") * 4 + F.col("k")
    lines = lines.withColumns({"at": at, "block": F.floor(at / 64)})
    records = folders.stored(csvio.quoted_records(lines, F.col("at"), "user_id", "block"), "csv-records")
    good, _ = csvio.parse_applications(records, order=F.col("at"), file="user_id", block=["block"])
    return good.select(F.col("file").alias("user_id"), F.col("n").cast("long").alias("n"), "company_name", "application_date", "status", "notes")


@query(f"with {D} select id, 'data:text/plain;base64,' || base64(encode(text)) url from docs")
def document_data_url(spark, d):
    return x.documents(spark, d).select("id", blobs.data_url(F.col("text").cast("binary"), F.lit("text/plain")).alias("url"))


@query(f"with {D} select id, text from docs")
def document_decode(spark, d):
    u = x.documents(spark, d).select("id", blobs.data_url(F.col("text").cast("binary"), F.lit("text/plain")).alias("url"))
    return u.select("id", blobs.decoded(F.col("url")).cast("string").alias("text"))


@query(f"with {D} select id, case when file_size < 1024 then file_size || ' Bytes' else regexp_replace(printf('%.2f', floor(file_size / 1024 * 100 + 0.5) / 100), '\\.?0+$', '') || ' KB' end size from docs")
def document_sizes(spark, d):
    return x.documents(spark, d).select("id", texts.human_size(F.col("file_size")).alias("size"))


@query(f"with {T} select id, cast(json_extract(props, '$.k') as int) k, coalesce(json_extract_string(props, '$.full_name'), '') full_name from tasks")
def json_fields(spark, d):
    return x.tasks(spark, d).select("id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.full_name"), F.lit("")).alias("full_name"))


@query("""select event_id id, 't' || event_id title, case when event_id % 3 = 0 then null else 'High' end priority, case when event_id % 3 <> 1 then ['title', 'priority'] else ['title'] end given
from events where event_id % 7 <> 0 and event_id % 3 <> 1 union all select event_id, 't' || event_id, null, ['title'] from events where event_id % 7 <> 0 and event_id % 3 = 1""")
def json_requests(spark, d):
    """Request bodies as rows: a field may be left out or null; what is no object is an error."""
    m = F.col("event_id") % 3
    tail = F.when(m == 0, ', "priority": null').when(m == 1, "").otherwise(', "priority": "High"')
    body = F.when(F.col("event_id") % 7 == 0, "[not json").otherwise(F.concat(F.lit('{"title": "t'), F.col("event_id").cast("string"), F.lit('"'), tail, F.lit("}")))
    return requests.parse_bodies(x.table(spark, d, "events").select(F.col("event_id").alias("id"), body.alias("body")), "title string, priority string")[0]


@query("select doc_id id, case when coalesce(n_chars, 0) % 5 = 0 then 'Unknown size' when n_chars < 1024 then n_chars || ' Bytes' else regexp_replace(printf('%.2f', floor(n_chars / 1024 * 100 + 0.5) / 100), '\\.?0+$', '') || ' KB' end size from documents")
def document_sizes_shown(spark, d):
    n = F.when(F.col("n_chars") % 5 == 0, F.when(F.col("n_chars") % 2 == 0, 0)).otherwise(F.col("n_chars"))
    return x.table(spark, d, "documents").select(F.col("doc_id").alias("id"), texts.shown_size(n).alias("size"))


# ---- scalar functions -------------------------------------------------------------------------------------------------


@query("""select c_custkey id, upper(array_to_string([w[1] for w in [v for v in regexp_split_to_array(replace(c_name, '#', ' ') || '@x.org', '\\s+|@') if v <> ''][1:2]], '')) initials,
lower(c_name) low, upper(c_mktsegment) up, lpad(cast(c_nationkey as varchar), 4, '0') padded, case when c_nationkey % 2 = 0 then '-' else c_mktsegment end fallback from customer""")
def text_functions(spark, d):
    c = x.table(spark, d, "customer")
    seg = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return c.select(
        F.col("c_custkey").alias("id"), texts.initials(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("@x.org"))).alias("initials"), F.lower("c_name").alias("low"),
        F.upper("c_mktsegment").alias("up"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"), texts.or_else(seg, "-").alias("fallback"),
    )


@query("select p_partkey id, cast(floor(p_retailprice - 950.5 + 0.5) as bigint) rounded, " + pct("p_size", "(p_partkey % 7)") + " change, least(greatest(p_size, 10), 40) clamped, cast(ceil(p_size / 10) as bigint) pages, try_cast(nullif(regexp_extract(p_brand[7:], '^\\s*([+-]?[0-9]+)', 1), '') as int) lead_int from part")
def number_functions(spark, d):
    p = x.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), numbers.js_round(F.col("p_retailprice") - 950.5).alias("rounded"), numbers.pct_change(F.col("p_size"), F.col("p_partkey") % 7).alias("change"),
        numbers.clamp(F.col("p_size"), 10, 40).alias("clamped"), numbers.pages_of(F.col("p_size"), 10).alias("pages"), numbers.leading_int(F.substring("p_brand", 7, 9)).alias("lead_int"),
    )


@query(f"""with {T}, {P} select t.id, timezone(z, timezone('UTC', created_at)) wall, cast(timezone(z, timezone('UTC', created_at)) as date) today, created_at - (timezone(z, timezone('UTC', created_at)) - created_at) utc,
timezone('UTC', timezone(z, created_at)) utc_strict, strftime(timezone(z, timezone('UTC', created_at)), '%Y-%m-%dT%H:%M') input, strftime(timezone(z, timezone('UTC', created_at)), '%b %-d, %Y') shown
from tasks t join (select id pid, coalesce(nullif(time_zone, ''), 'America/New_York') z from profiles) on pid = user_id""")
def zone_functions(spark, d):
    p = x.profiles(spark, d).select(F.col("id").alias("user_id"), dates.zone_or_default(F.col("time_zone")).alias("z"))
    at, z = F.col("created_at"), F.col("z")
    return x.tasks(spark, d).join(p, "user_id").select(
        "id", dates.wall_clock(at, z).alias("wall"), dates.today_in(at, z).alias("today"), dates.wall_to_utc(at, z).alias("utc"), dates.wall_to_utc(at, z, strict=True).alias("utc_strict"),
        dates.input_time(at, z).alias("input"), F.date_format(dates.wall_clock(at, z), "MMM d, yyyy").alias("shown"),
    )


@query(f"""with {T}, {P} select t.id, cast(date_diff('minute', created_at, timezone(z, timezone('UTC', created_at))) as bigint) offset_minutes
from tasks t join (select id pid, coalesce(nullif(time_zone, ''), 'America/New_York') z from profiles) on pid = user_id""")
def zone_offsets(spark, d):
    p = x.profiles(spark, d).select(F.col("id").alias("user_id"), dates.zone_or_default(F.col("time_zone")).alias("z"))
    return x.tasks(spark, d).join(p, "user_id").select("id", dates.zone_offset(F.col("created_at"), F.col("z")).alias("offset_minutes"))


@query(f"""with {T}, c as (select id, created_at, id % 7 k from tasks)
select id, case when k in (0, 1, 2) then null when k = 3 then date_trunc('day', created_at) when k = 4 then date_trunc('second', created_at) when k = 5 then date_trunc('second', created_at) - interval 330 minute else date_trunc('millisecond', created_at) end instant,
case when k in (0, 1, 2) then null else cast(case when k = 5 then date_trunc('second', created_at) - interval 330 minute else created_at end as date) end "day", strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(extract(millisecond from created_at) % 1000 as varchar), 3, '0') || 'Z' shown from c""")
def iso_texts(spark, d):
    """Times as ISO texts of several kinds, a few of them no times, read back."""
    at, k = F.col("created_at"), F.pmod("id", F.lit(7))
    text = (F.when(k == 0, "not a date").when(k == 1, "2024-02-30").when(k == 2, "").when(k == 3, F.date_format(at, "yyyy-MM-dd"))
            .when(k == 4, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 5, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+05:30'")).otherwise(dates.iso_text(at)))
    rows_ = x.tasks(spark, d).select("id", "created_at", text.alias("text"), dates.iso_text(at).alias("shown")).withColumn("instant", dates.iso_instant(F.col("text")))
    return rows_.select("id", "instant", F.col("instant").cast("date").alias("day"), "shown")


@query(f"""with {A} select id, cast(date_trunc('week', application_date) as date) wk, cast(date_trunc('month', application_date) as date) "month", least(application_date - interval 1 month, last_day(application_date - interval 1 month))::date month_ago,
last_day(application_date) month_end, application_date - 6 back, cast(isodow(application_date) - 1 as int) weekday from apps""")
def day_functions(spark, d):
    day = F.col("application_date")
    return x.applications(spark, d).select(
        "id", dates.week_start(day).alias("wk"), F.trunc(day, "MM").alias("month"), dates.same_day_last_month(day).alias("month_ago"), F.last_day(day).alias("month_end"),
        F.date_sub(day, 6).alias("back"), F.weekday(day).alias("weekday"),
    )


@query(f"with {A}, c as (select user_id, status, count(*) n from apps group by 1, 2) select user_id, list(status || ': ' || n order by status) counts, sum(n) filter (status = 'Applied') applied from c group by 1")
def status_map(spark, d):
    by_status = F.map_from_entries(F.collect_list(F.struct("status", "cnt")))
    m = agg.status_breakdown(x.applications(spark, d)).groupBy("user_id").agg(by_status.alias("m"))
    listed = F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat_ws(": ", e.key, e.value.cast("string"))))
    return m.select("user_id", listed.alias("counts"), F.try_element_at("m", F.lit("Applied")).alias("applied"))


@query(f"""with {A} select id, strftime(application_date, '%a') weekday, strftime(application_date, '%-d') "day", strftime(application_date, '%A, %b %-d') title,
strftime(application_date + to_hours(id % 24), '%-I:%M %p') "time", case when id % 3 = 0 then '' when id % 3 = 1 then 'soon' else strftime(application_date, '%b %-d, %Y') end shown,
case when id % 3 = 2 then application_date end parsed from apps""")
def calendar_labels(spark, d):
    day = F.col("application_date")
    at = F.timestamp_add("HOUR", (F.col("id") % 24).cast("int"), day.cast("timestamp_ntz"))
    text = F.when(F.col("id") % 3 == 1, "soon").when(F.col("id") % 3 == 2, day.cast("string"))
    return x.applications(spark, d).select(
        "id", dates.calendar_label(day, "weekday").alias("weekday"), dates.calendar_label(day, "day").alias("day"), dates.calendar_label(day, "title").alias("title"),
        dates.calendar_label(at, "time").alias("time"), dates.display_day_text(text, F.lit("UTC")).alias("shown"), texts.date_only(text).alias("parsed"),
    )
