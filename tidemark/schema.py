"""The record: one statement of fact, its vector, its moment and its place in a revision group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between the parts of a group key (fixed value).
GROUP_SEPARATOR = "\u001f"

FACTS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("group_key", T.StringType()),
    T.StructField("declared", T.BooleanType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def group_key(user_id: Column, project: Column, entity: Column) -> Column:
    """``user \\x1f project \\x1f entity``; null where there is no entity. Nulls of the first two count as empty."""
    part = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.when(F.coalesce(entity, F.lit("")) != "", F.concat_ws(GROUP_SEPARATOR, part(user_id), part(project), entity))


def with_group_key(facts: DataFrame) -> DataFrame:
    return facts.withColumn("group_key", group_key(F.col("user_id"), F.col("project"), F.col("entity")))


def epoch_seconds(rows: DataFrame, name: str) -> Column:
    """Seconds since 1970 as a double, to the microsecond. A time without zone is taken as UTC, whatever the session's zone."""
    if dict(rows.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name)) / F.lit(1e6)
    return F.unix_micros(F.col(name)) / F.lit(1e6)
