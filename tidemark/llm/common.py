"""Shared helpers: durable intermediate tables, text columns as bytes, connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.runtime import ship_package

#: Java regex of a word: a run of anything but ASCII white space.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the session names.

    Where it names none, a local session (as in tests) gets one; on a cluster a machine-local folder would
    lose data, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/tidemark")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders that :func:`materialize` has made, by application.
_SCRATCH: dict[str, list[str]] = {}


#: Whether Spark drops the shuffle files of a query when it ends, not whenever the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    The folder stays until :func:`clear_scratch`, as results may still read it. ``drop_shuffles``: what was
    shuffled on the way goes from the disks as soon as the table is written.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(folder)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    try:
        spark.conf.set(_DROP_SHUFFLES, "true" if drop_shuffles else before)
        df.write.parquet(f"{folder}/{tag}")
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/{tag}")


def clear_scratch(spark: SparkSession, keep_last: int = 0) -> int:
    """Delete what the operators of this application have written to the shared folder, but for the last ``keep_last`` folders.

    Call it once results are stored.
    """
    folders = _SCRATCH.get(spark.sparkContext.applicationId, [])
    cut = len(folders) - keep_last
    for folder in folders[:cut]:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _SCRATCH[spark.sparkContext.applicationId] = folders[cut:]
    return cut


def text_bytes(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and the whole text as UTF-8 bytes (null: empty), for Arrow functions."""
    ship_package(docs.sparkSession)
    return docs.select(*keys, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, for functions that return it."""
    return to_arrow_type(df.schema[column].dataType)


def in_fold(doc_id, modulus: int):
    """True where crc32 of the id as text leaves no remainder (null id: as the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == 0


#: Edges that one task takes in a round of :func:`components`.
EDGES_A_TASK = 50_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row ``(node, root)``, root the least node reachable.

    Min-label hooking with pointer jumping, so rounds grow with the logarithm of a component's
    diameter. Every step is a join or a partially aggregated minimum, nothing is collected; each
    round is written to the shared folder, and only the number of changed labels reaches the driver.
    Rounds use as many tasks as the number of edges calls for, as most tables of links are small.
    """
    sym = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    tasks = sym.count() // EDGES_A_TASK + 1
    kept = lambda df, tag: materialize(df.coalesce(tasks), tag)
    labels = kept(sym.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels0")
    turn = 0
    while True:
        turn += 1
        at_b = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        at_a = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        seen = sym.join(at_b, "b").join(at_a, "a")
        offers = seen.select(F.explode(F.array("a", "root_a")).alias("node"), "root_b").groupBy("node").agg(F.min("root_b").alias("offer"))
        hooked = labels.join(offers, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        hooked = kept(hooked, f"hooked{turn}")
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        labels = kept(hooked.join(above, "root", "left").select("node", "was", F.least("root", F.coalesce("upper", "root")).alias("root")), f"labels{turn}")
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
