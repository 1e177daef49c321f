"""A stored table as a stream, and a stream run to the end of what there is."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pipetally.sources.folders import fresh_folder
from pipetally.streaming.timers import PROVIDER


@contextmanager
def state_store(spark: SparkSession, provider: str = PROVIDER) -> Iterator[None]:
    """The session's state store provider, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at ``path`` (with a slash and a name in it) as a stream."""
    folder, _, name = path.rpartition("/")
    # a pattern, as a stream reads a folder or what a pattern finds, and the table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def replayed(found: DataFrame) -> DataFrame:
    """What the stream ``found`` has written when it has read all there is, as a table in the shared folder."""
    spark = found.sparkSession
    out = fresh_folder(spark, "replayed")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(spark, "replay-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
