"""Every registered query against its SQL, and properties of the series."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pipetally import queries as tracking
from pipetally.operators import aggregates as agg
from pipetally.sources import crosswalk as x


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v if isinstance(v, int) else str(v)
    return sorted(repr([show(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", list(tracking.ORACLES))
def test_matches_sql(spark, small, oracle, name):
    df = tracking.QUERIES[name](spark, small)
    want = oracle.execute(tracking.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, df.collect()) == canon(names, want.fetchall())


def test_queries_without_sql_run(spark, small):
    for name in set(tracking.QUERIES) - set(tracking.ORACLES):
        assert tracking.QUERIES[name](spark, small).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_tenant_result_is_the_filtered_one(spark, small):
    apps, day = x.applications(spark, small), F.lit("2001-08-01").cast("date")
    every = agg.timeseries(apps, day).filter("user_id = 7")
    one = agg.timeseries(apps.filter("user_id = 7"), day)
    assert sorted(every.collect()) == sorted(one.collect())


def test_series_adds_up(spark, small):
    rows = agg.cumulative(agg.with_spine(agg.daily_counts(x.tasks(spark, small), "created_at"), F.lit("2024-01-30").cast("date"), 14)).collect()
    for u in {r.user_id for r in rows}:
        mine = sorted((r.day, r.n, r.cumulative) for r in rows if r.user_id == u)
        assert [c for _, _, c in mine] == sorted(c for _, _, c in mine) and mine[-1][2] == sum(n for _, n, _ in mine)


def test_scan_is_pruned_and_filters_are_pushed(spark, small):
    plan = tracking.QUERIES["search_ilike"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan
    plan = tracking.QUERIES["scan_tenant"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan


def test_declared_schemas_are_the_stored_ones(spark, small):
    for name in x.SCHEMAS:
        assert x.table(spark, small, name).dtypes == spark.read.parquet(f"{small}/{name}.parquet").dtypes
