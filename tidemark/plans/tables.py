"""The driver tables seen as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import chunk_column, doc_fingerprint, doc_id
from tidemark.runtime import ship_package
from tidemark.schema import epoch_seconds, with_group_key

#: A fixed "now" for queries about age (2024-02-01 00:00 UTC), and two moments inside the tables' month.
NOW, SINCE, UNTIL = 1706745600.0, 1704844800.0, 1705276800.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrival(column: str = "event_id"):
    """A fixed shuffle of ids: the first 60 bits of their md5."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def events(spark: SparkSession, sf_dir: str, backfilled: bool = False, untagged: str | None = None) -> DataFrame:
    """Events as facts: a chain per user and type. ``backfilled`` shuffles arrival, ``untagged`` takes a type's tag away."""
    rows = read(spark, sf_dir, "events")
    text = F.concat_ws(":", "event_type", "event_id")
    entity = F.col("event_type") if untagged is None else F.when(F.col("event_type") != untagged, F.col("event_type"))
    facts = with_group_key(rows.select(
        (arrival() if backfilled else F.col("event_id")).alias("row_id"), doc_id(text).alias("doc_id"), text.alias("text"), F.lit("api").alias("source"), F.col("props").alias("metadata"),
        epoch_seconds(rows, "ts").alias("ts"), F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("project"), entity.alias("entity"), (F.col("event_type") == "purchase").alias("declared"), "event_id", "value",
    ))
    counted = F.row_number().over(Window.partitionBy("group_key").orderBy("row_id"))
    return facts.withColumn("revision", F.when(F.col("group_key").isNull(), F.lit(1)).otherwise(counted).cast("int"))


def events_sql(backfilled: bool = False, untagged: str | None = None) -> str:
    """``facts`` as a common table expression for DuckDB."""
    row = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT)" if backfilled else "event_id"
    entity = "event_type" if untagged is None else f"CASE WHEN event_type <> '{untagged}' THEN event_type END"
    return f"""raw AS (
        SELECT {row} AS row_id, event_id, event_type || ':' || event_id AS text, 'doc_' || substr(md5(event_type || ':' || event_id), 1, 10) AS doc_id,
               props AS metadata, epoch_us(ts) / 1e6 AS ts, CAST(user_id AS VARCHAR) AS user_id, {entity} AS entity, event_type = 'purchase' AS declared, value
        FROM events),
    facts AS (
        SELECT *, CASE WHEN entity IS NULL THEN 1 ELSE CAST(row_number() OVER (PARTITION BY user_id, entity ORDER BY row_id) AS INT) END AS revision FROM raw)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumn("row_id", F.col("vec_id"))


def query_vectors(spark: SparkSession, sf_dir: str, ids: list[int] | None = None) -> list[tuple[int, list[float]]]:
    """Rows' vectors as queries: those of a few ids, or all. Queries are held on the driver by their nature."""
    rows = vectors(spark, sf_dir)
    return _as_queries(rows if ids is None else rows.where(F.col("vec_id").isin(ids)))


def every_50th(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """The query set of batch searches: every row whose id is divisible by 50."""
    return _as_queries(vectors(spark, sf_dir).where("vec_id % 50 = 0"))


def _as_queries(rows: DataFrame) -> list[tuple[int, list[float]]]:
    got = rows.select("vec_id", "embedding").orderBy("vec_id").collect()
    return [(r.vec_id, [float(x) for x in r.embedding]) for r in got]


def facts_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as facts: the attribute is named by the label ("shelf_a" for 0), a chain per label and id parity, time from the id."""
    rows = vectors(spark, sf_dir)
    facts = rows.select(
        "row_id", F.concat(F.lit("doc_"), "vec_id").alias("doc_id"), F.concat(F.lit("statement "), "vec_id").alias("text"), F.lit("chat").alias("source"), F.lit("{}").alias("metadata"), (F.lit(1.7e9) + F.col("vec_id") * 3600).alias("ts"),
        (F.col("vec_id") % 2).cast("string").alias("user_id"), F.lit(None).cast("string").alias("project"), F.concat(F.lit("shelf_"), F.char(F.col("label") + 97)).alias("entity"), F.lit(True).alias("declared"), "embedding",
    )
    facts = with_group_key(facts)
    return facts.withColumn("revision", F.row_number().over(Window.partitionBy("group_key").orderBy("row_id")).cast("int"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunked facts: one attribute a source, chunks named by their parent."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    rows = docs.select("doc_id", "source", doc_fingerprint(F.col("text")).alias("sha"), F.posexplode(chunk_column(F.col("text"))).alias("at", "text"))
    parent = F.concat(F.lit("doc_"), F.col("doc_id"))
    meta = F.to_json(F.struct(parent.alias("parent_id"), F.col("at").alias("chunk_index"), F.col("sha").alias("parent_sha256")))
    return with_group_key(rows.select(
        (F.col("doc_id") * 100000 + F.col("at")).alias("row_id"), F.concat(parent, F.lit("_chunk_"), F.col("at")).alias("doc_id"), "text", "source", meta.alias("metadata"),
        (F.lit(1.7e9) + F.col("doc_id") * 60).cast("double").alias("ts"), F.lit("u").alias("user_id"), F.lit(None).cast("string").alias("project"), F.col("source").alias("entity"), F.lit(True).alias("declared"), F.lit(1).alias("revision"),
    ))
