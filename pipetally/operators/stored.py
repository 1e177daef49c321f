"""Tables in folders: writes that touch what changed, batches that appear whole, layouts that joins and filters use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of a row: tenants are dealt into so many.
BUCKETS = 64
BUCKET = "bucket"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(F.col(key), buckets))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in ranges of bucket and tenant; one tenant's may be in several ranges, so none is too large for a task."""
    whole = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    order = [F.col(BUCKET), F.col(key), F.xxhash64(*whole)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])


def write_by_tenant(df: DataFrame, path: str, key: str = "user_id", buckets: int = BUCKETS, dynamic: bool = False) -> None:
    """``df`` as a table at ``path``, a folder a bucket of tenants, each sorted by tenant, so that min and max prune row groups.

    With ``dynamic`` only the folders that ``df`` has rows for are replaced.
    """
    _dealt(_with_bucket(df, key, buckets), key).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic" if dynamic else "static").mode("overwrite").parquet(path)


def read_by_tenant(spark: SparkSession, path: str, user_id: object = None, key: str = "user_id", buckets: int = BUCKETS) -> DataFrame:
    """The table at ``path``; of one tenant, only its folder is read."""
    df = spark.read.parquet(path)
    if user_id is None:
        return df.drop(BUCKET)
    value = F.lit(user_id).cast(df.schema[key].dataType)
    return df.filter((F.col(BUCKET) == bucket_of(value, buckets)) & (F.col(key) == value)).drop(BUCKET)


def update_by_tenant(spark: SparkSession, path: str, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], key: str = "user_id", buckets: int = BUCKETS) -> list[int]:
    """Rewrite the folders of the tenants that ``changes`` (with ``key``) name: ``change`` (their rows, changes) gives their new rows.

    Folders of other tenants are neither read nor written.  A folder whose rows all go is left empty.  The new
    rows are staged beside the table first, as a folder cannot be read and replaced in one job; a failure
    before the replacement leaves the table as it was.  Returns the buckets replaced, at most ``buckets``.
    """
    touched = sorted(r[0] for r in changes.select(bucket_of(F.col(key), buckets).alias(BUCKET)).distinct().collect())
    if not touched:
        return []
    table = spark.read.parquet(path)
    mine = table.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    staged = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, staged)
    try:
        write_by_tenant(change(mine, changes), staged, key, buckets)
        left = spark.read.schema(table.schema).parquet(staged)
        have = {r[0] for r in left.select(BUCKET).distinct().collect()}
        if have - set(touched):
            raise ValueError(f"rows of other tenants' buckets: {sorted(have - set(touched))}")
        _dealt(left, key).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        for b in sorted(set(touched) - have):
            _hadoop(spark, f"{path}/{BUCKET}={b}")[0].delete(_hadoop(spark, f"{path}/{BUCKET}={b}")[1], True)
    finally:
        fs.delete(at, True)
    return touched


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add ``df`` to the table at ``path`` as its partition ``batch``, all or nothing; whether it was added.

    All files are written to a hidden folder, which readers pass over, and then one rename gives it its
    name.  Whatever fails before leaves the table as it was, and the same call again adds the batch; a
    batch that is there is not added twice.
    """
    spark = df.sparkSession
    name, staged = f"{path.rstrip('/')}/batch={batch}", f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, staged)
    _, final = _hadoop(spark, name)
    if fs.exists(final):
        return False
    try:
        df.write.parquet(staged)
        if not _renamed(fs, at, final):
            return False
        # where the name was taken meanwhile, the rename has moved the folder into that one, still hidden
        _, inside = _hadoop(spark, f"{name}/{staged.rpartition('/')[2]}")
        return not (fs.exists(inside) and fs.delete(inside, True))
    finally:
        fs.delete(at, True)


def _renamed(fs, at, final) -> bool:
    return fs.rename(at, final)


def save_bucketed(df: DataFrame, name: str, key: str = "user_id", buckets: int = BUCKETS) -> DataFrame:
    """``df`` as the catalog table ``name``, bucketed and sorted by tenant: tables alike join and group by it without a shuffle."""
    # one file a bucket: each task has the rows of its buckets
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
