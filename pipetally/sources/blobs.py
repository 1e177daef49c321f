"""Binary documents as data URLs, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipetally.functions.texts import unbroken_base64


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"), unbroken_base64(content))


def decoded(url: Column) -> Column:
    """The bytes of a data URL."""
    return F.unbase64(F.substring_index(url, ",", -1))


def encode_documents(files: DataFrame, mime: str = "application/octet-stream") -> DataFrame:
    """(filename, file_size, file_path) of rows of Spark's ``binaryFile`` source."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), data_url(F.col("content"), F.lit(mime)).alias("file_path"))


def read_documents(spark: SparkSession, path: str, mime: str = "application/octet-stream") -> DataFrame:
    return encode_documents(spark.read.format("binaryFile").load(path), mime)
