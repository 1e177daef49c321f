"""JSON request bodies as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_bodies(bodies: DataFrame, schema: StructType | str, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON texts: the fields of ``schema`` beside the other columns, and ``given``, the fields that a body holds.

    A body that is no JSON object, or has a field of another type, is an error; unknown fields are ignored;
    a field that is left out is null and not ``given``; one set to null is.
    """
    rest = [c for c in bodies.columns if c != column]
    kind = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    with_bad = StructType.fromDDL(kind[7:-1]).add("__bad", "string")
    parsed = bodies.select("*", F.from_json(F.col(column), with_bad, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("__r"), F.json_object_keys(column).alias("given"))
    wrong = F.col("__r").isNull() | F.col("__r.__bad").isNotNull() | F.col("given").isNull()
    fields = [F.col(f"__r.{n}").alias(n) for n in with_bad.names if n != "__bad"]
    good = parsed.filter(~F.coalesce(wrong, F.lit(True))).select(*rest, *fields, "given")
    return good, parsed.filter(F.coalesce(wrong, F.lit(True))).select(*rest, F.col(column), F.lit("Invalid request body").alias("message"))


def updated_fields(given: Column, allowed: list[str]) -> Column:
    """The fields that a partial update may set among those that were given."""
    return F.array_intersect(given, F.array(*[F.lit(a) for a in allowed]))
