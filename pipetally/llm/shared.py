"""What the operators share: the folder that all machines see, written tables, sampling, small batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A worker handles so many rows, or about so many bytes of them, at a time: texts are whole and may be long.
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are this process (tests) may do without: it gets a temporary one.
    On a cluster each machine would have a folder of its own, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="pipetally-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables written inside of each ``scratch`` that is open.
_OPEN: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and survives the loss of any executor.

    With ``keep`` it outlives the innermost ``scratch`` around it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _OPEN[: len(_OPEN) - keep]:
        _OPEN[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is returned from here must be written with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in _OPEN.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def freed(df: DataFrame) -> DataFrame:
    """``df``, a written table, after asking for the shuffle files of the plans behind it to go.

    Spark deletes them when the driver's garbage is collected; a row of many small jobs makes little garbage, and
    would keep the files of all of them.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def text_hash(column: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(column))


def _cut(distinct: Column, rows: int) -> Column:
    """The hash below which about ``rows`` of ``distinct`` evenly spread 64-bit hashes lie."""
    share = F.least(F.lit(1.0), F.lit(float(rows)) * 1.2 / F.greatest(distinct.cast("double"), F.lit(1.0)))
    return F.when(share >= 1.0, F.lit((1 << 63) - 1)).otherwise((F.lit(float(-(1 << 63))) + share * float(1 << 64)).cast("bigint"))


def text_sample(df: DataFrame, key: str, rows: int, seed: int, by: str | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df`` with different texts ``key`` (for each value of ``by``, if given), chosen by a hash of the text.

    A repeated text counts once, so no group of copies can fill the sample or leave it.  Only used to
    fit classifiers; the bound is a documented parameter of each of them.  Only hashes are ranked.
    """
    hashed = df.withColumn("__h", text_hash(key, seed))
    keys = [by] if by else []
    cuts = hashed.groupBy(*keys).agg(F.approx_count_distinct("__h").alias("__d")).select(*keys, _cut(F.col("__d"), rows).alias("__cut"))
    near = hashed.join(F.broadcast(cuts), keys) if by else hashed.join(F.broadcast(cuts), F.lit(True))
    near = near.filter(F.col("__h") <= F.col("__cut")).drop("__cut")
    # about 1.2 x rows hashes (a value of ``by``) are left to rank
    rank = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("__h"))
    last = near.select(*keys, "__h").distinct().withColumn("__r", rank).filter(F.col("__r") <= rows).groupBy(*keys).agg(F.max("__h").alias("__last"))
    last = F.broadcast(written(last, "sample-cut"))
    some = near.join(last, keys) if by else near.join(last, F.lit(True))
    return some.filter(F.col("__h") <= F.col("__last")).dropDuplicates([*keys, "__h"]).select(*df.columns)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check made before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: What a worker process keeps from task to task, by name, and the stage that it is kept for.
_KEPT: dict[str, object] = {}
_STAGE: list[int | None] = [None]


def kept[T](name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, once in a worker process for all its tasks of a stage; its first task of another stage lets go of it."""
    let_go()
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Drop what this worker process keeps for tasks of another stage than that of the task it is at.

    Workers outlive stages, and an executor has as many as it has cores, so what one stage remembers would
    count against the memory of every later one.
    """
    task = TaskContext.get()
    now = task.stageId() if task else None
    if now != _STAGE[0]:
        _STAGE[0] = now
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        pa.default_memory_pool().release_unused()


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into small ones, by rows and by bytes, whatever the session's batch size is."""
    let_go()
    for b in batches:
        rows = b.num_rows
        step = max(1, min(PIECE_ROWS, int(rows * PIECE_BYTES / max(b.nbytes, 1))))
        for at in range(0, rows, step):
            yield b.slice(at, step)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it; on a cluster submit it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
