"""Stored tables, whole batches, deep pages, counted writes and policies."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pipetally.operators import changes, rows, stored


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def table(spark, n=5000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 211).alias("user_id"), F.lit("a").alias("v"))


def test_only_touched_folders_change(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark)
    stored.write_by_tenant(df, path, buckets=16)
    before = files_of(path)
    asked = df.filter("user_id in (7, 8)").withColumn("v", F.lit("b"))
    got = stored.update_by_tenant(spark, path, asked, lambda mine, c: changes.apply_updates(mine, c.select("id", "v"), ["id"]), buckets=16)
    after = files_of(path)
    touched = {f"bucket={b}" for b in got}
    assert len(got) in (1, 2) and {f for f in before if f.split("/")[-2] not in touched} <= set(after)
    assert all(after[f] == t for f, t in before.items() if f.split("/")[-2] not in touched)
    assert {f.split("/")[-2] for f in set(after) - set(before)} == touched
    want = {(r.id, r.user_id, "b" if r.user_id in (7, 8) else "a") for r in df.collect()}
    assert {tuple(r) for r in stored.read_by_tenant(spark, path).collect()} == want
    assert stored.read_by_tenant(spark, path, 7, buckets=16).count() == df.filter("user_id = 7").count()


def test_a_folder_can_become_empty_and_a_failure_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, 600)
    stored.write_by_tenant(df, path, buckets=8)
    before = files_of(path)
    with pytest.raises(Exception, match="no luck"):
        stored.update_by_tenant(spark, path, df.filter("user_id = 9"), lambda mine, c: mine.withColumn("v", F.when(F.col("user_id") == 9, F.raise_error(F.lit("no luck"))).otherwise(F.col("v"))), buckets=8)
    with pytest.raises(ValueError, match="other tenants"):
        stored.update_by_tenant(spark, path, df.filter("user_id = 9"), lambda mine, c: mine.withColumn("user_id", F.col("id")), buckets=8)
    assert files_of(path) == before and not glob.glob(f"{path}._staged*")
    bucket = df.filter("user_id = 9").select(stored.bucket_of(F.col("user_id"), 8)).first()[0]
    mates = df.filter(stored.bucket_of(F.col("user_id"), 8) == bucket)
    assert stored.update_by_tenant(spark, path, mates, lambda mine, c: mine.limit(0), buckets=8) == [bucket]
    assert stored.read_by_tenant(spark, path).count() == 600 - mates.count()
    assert stored.update_by_tenant(spark, path, df.limit(0), lambda mine, c: mine, buckets=8) == []


def test_one_tenant_reads_one_folder_and_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    big = spark.range(200_000).select("id", (F.col("id") % 400).alias("user_id"))
    stored.write_by_tenant(big, path, buckets=4)
    plan = stored.read_by_tenant(spark, path, 9, buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(user_id,9)" in plan
    # the files of a bucket are sorted by tenant, so their ranges of tenants hardly overlap
    spans = spark.read.parquet(path).groupBy("bucket", F.input_file_name().alias("f")).agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).collect()
    for r in spans:
        assert sum(1 for s in spans if s.bucket == r.bucket and s.f != r.f and s.a < r.b and r.a < s.b) == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = stored.save_bucketed(spark.range(2000).select("id", (F.col("id") % 50).alias("user_id")), "apps_bucketed", buckets=4)
        b = stored.save_bucketed(spark.range(50).select(F.col("id").alias("user_id"), F.lit("x").alias("name")), "who_bucketed", buckets=4)
        joined = a.join(b, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
        assert joined.count() == 50 and joined.agg(F.sum("n")).first()[0] == 2000
        plan = a.join(b, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists apps_bucketed")
        spark.sql("drop table if exists who_bucketed")


def test_a_batch_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.range(100).select("id", F.lit("x").alias("v"))
    assert stored.publish_batch(one, path, "1") and not stored.publish_batch(one, path, "1")
    look = lambda: sorted((r.batch, r.id) for r in spark.read.parquet(path).collect())
    old = look()
    # a task dies while files are staged: others have written theirs
    broken = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="lost"):
        stored.publish_batch(broken, path, "2")
    assert look() == old and sorted(os.listdir(path)) == ["batch=1"]

    def dies(*_):
        raise RuntimeError("between staging and rename")

    with monkeypatch.context() as m:
        m.setattr(stored, "_renamed", dies)
        with pytest.raises(RuntimeError):
            stored.publish_batch(one, path, "2")
    assert look() == old
    assert stored.publish_batch(one, path, "2") and len(look()) == 200
    # another writer is first, after the look and before the rename
    rename = stored._renamed

    def late(fs, at, final):
        one.limit(5).write.parquet(f"{path}/batch=3")
        return rename(fs, at, final)

    with monkeypatch.context() as m:
        m.setattr(stored, "_renamed", late)
        assert not stored.publish_batch(one, path, "3")
    assert len(look()) == 205 and os.path.isdir(f"{path}/batch=3") and not glob.glob(f"{path}/batch=3/_staged*")


ORDER = [("day", True), ("id", False)]


def plain_page(df, number, limit, order):
    return [tuple(r) for r in df.orderBy(*rows.sort_columns(order)).offset((number - 1) * limit).limit(limit).collect()]


@pytest.mark.parametrize("order", [ORDER, [("day", False), ("id", True)], [("name", True), ("day", False), ("id", False)], [("id", False)]])
def test_deep_pages_equal_plain_ones(spark, order):
    skewed = F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 97)  # a third of the rows on one day
    df = spark.range(6000).select("id", F.when(F.col("id") % 50 != 0, F.date_add(F.lit("2024-01-01").cast("date"), skewed.cast("int"))).alias("day"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("n"), (F.col("id") % 13).cast("string"))).alias("name"))
    df = df.repartition(6).cache()
    for number in (1, 2, 10, 77, 150, 301, 600, 601, 10**6):
        got, envelope = rows.deep_page(df, number, 10, order, most=300)
        assert [tuple(r) for r in got.collect()] == plain_page(df, number, 10, order), number
        assert tuple(envelope.first()) == (number, 10, 6000, 600)
    assert [tuple(r) for r in rows.deep_page(df, 3, 1999, order, most=300)[0].collect()] == plain_page(df, 3, 1999, order)
    assert rows.deep_page(df.limit(0), 1, 10, order)[1].first().total == 0
    with pytest.raises(ValueError):
        rows.deep_page(df, 0, 10, order)


def test_page_100000_sorts_a_range(spark, tmp_path):
    spark.range(0, 3_000_000, 1, 8).select("id", (F.col("id") % 100_003).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = [("k", False), ("id", False)]
    got, envelope = rows.deep_page(df, 100_000, 20, order, most=60_000)
    assert [tuple(r) for r in got.collect()] == plain_page(df, 100_000, 20, order)
    assert envelope.first().total == 3_000_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "k#" in plan and ("> " in plan or "= " in plan)  # the range reaches the scan
    assert "LessThan(k," in got._jdf.queryExecution().executedPlan().toString()


def test_failures_are_counted_as_rows_are_written(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2))
    out = changes.counted_write(df, F.col("v") == 1, lambda d: d.write.parquet(str(tmp_path / "out")), F.concat(F.lit("no "), F.format_string("%04d", "id")))
    want = [i for i in range(1000) if i % 7 and i % 2]
    assert tuple(out.first()) == (len(want), 1000 - len(want), "no 0000")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    none = changes.counted_write(df.limit(0), F.lit(True), lambda d: d.write.parquet(str(tmp_path / "none")))
    assert tuple(none.first()) == (0, 0)


def test_cascade_goes_all_the_way(spark):
    rows_ = lambda *r: spark.createDataFrame(list(r), "id int, a int, b int")
    t = {"p": rows_((1, None, None), (2, None, None)), "q": rows_((10, 1, None), (11, 2, None), (12, None, None)), "r": rows_((20, 10, 2), (21, 11, 1), (22, 11, 2), (23, None, None), (24, 99, None)), "s": rows_((30, 20, None), (31, 22, None)), "free": rows_((1, 1, 1))}
    keys = [changes.ForeignKey("s", "a", "r"), changes.ForeignKey("r", "a", "q"), changes.ForeignKey("r", "b", "p"), changes.ForeignKey("q", "a", "p")]
    assert changes.parents_first(keys)[0] == "p"
    left = changes.cascade(t, keys, {"p": spark.createDataFrame([(1,), (77,), (1,)], "id int"), "free": spark.createDataFrame([(1,)], "id int")})
    assert {n: sorted(r.id for r in df.collect()) for n, df in left.items()} == {"p": [2], "q": [11, 12], "r": [22, 23, 24], "s": [31], "free": []}
    assert all(left[n].columns == t[n].columns for n in t)
    with pytest.raises(ValueError, match="cycle"):
        changes.parents_first([changes.ForeignKey("a", "x", "b"), changes.ForeignKey("b", "x", "a")])


def test_a_cascade_deals_large_tables_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(changes, "ROWS_A_TASK", 100)
    monkeypatch.setattr(changes, "BROADCAST_ROWS", 10)
    p, q = spark.range(1000), spark.range(4000).selectExpr("id", "id % 1000 a")
    keys = [changes.ForeignKey("q", "a", "p")]
    left = changes.cascade({"p": p, "q": q}, keys, {"p": p.filter("id % 5 = 0")}, {"p": 1000, "q": 4000})
    assert {r.id for r in left["q"].collect()} == {i for i in range(4000) if i % 1000 % 5} and left["p"].count() == 800
    # 4,000 rows are 40 tasks of 100, whatever the session's number of partitions
    assert left["q"].select(F.spark_partition_id().alias("k")).distinct().count() > 20


def test_policies_of_every_table_and_command(spark):
    assert len(changes.POLICIES) == 24
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id int, user_id int")
    assert [r.id for r in changes.visible(df, "tasks", F.lit(1)).collect()] == [1, 2]
    assert [r.id for r in changes.visible(df, "profiles", F.lit(3), "delete").collect()] == [3]
    with pytest.raises(ValueError):
        changes.visible(df, "secrets", F.lit(1))
    good, bad = changes.checked_insert(df, "tasks", F.lit(1))
    assert [r.id for r in good.collect()] == [1, 2] and {(r.id, r.error) for r in bad.collect()} == {(i, changes.FOREIGN + "tasks") for i in (3, 4)}
    asked = spark.createDataFrame([(1, 2, 1), (2, None, 1), (3, 9, 1), (99, None, 1)], "id int, user_id int, who int")
    after, refused = changes.checked_update(df, asked, "tasks", ["id"], "who")
    assert sorted(map(str, after.collect())) == sorted(map(str, df.collect())) and [r.id for r in refused.collect()] == [1]
    left = changes.checked_delete(df, spark.createDataFrame([(1, 1), (3, 1), (4, None), (1, 1)], "id int, who int"), "tasks", ["id"], "who")
    assert sorted(r.id for r in left.collect()) == [2, 3, 4]


def test_of_new_rows_with_one_key_the_first_by_value(spark):
    df = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(2, "z"), (2, "b"), (2, "m"), (1, "new")], "id int, v string").repartition(3)
    assert sorted(map(tuple, changes.insert_if_absent(df, new, "id").collect())) == [(1, "old"), (2, "b")]
