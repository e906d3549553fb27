"""Log analytics that read no vector: changes, volatility, staleness, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = "group_key"


def changes(facts: DataFrame, since: float, until: float | None = None, limit: int | None = None) -> DataFrame:
    """Rows of ``(since, until]`` by (ts, row_id); ``limit`` keeps the oldest. A reversed range is an error."""
    if until is not None and until < since:
        raise ValueError(f"until ({until}) is before since ({since})")
    rows = facts.where(F.col("ts") > since)
    rows = rows if until is None else rows.where(F.col("ts") <= until)
    rows = rows.orderBy("ts", "row_id")
    return rows if limit is None or limit < 0 else rows.limit(limit)


def as_of(facts: DataFrame, moment: float) -> DataFrame:
    return facts.where(F.col("ts") <= moment)


def intervals(facts: DataFrame, key: str = _KEY) -> DataFrame:
    """``(group_key, entity, ts, gap)``: every row of a chain and the time since the one before (null for the first)."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts"))
    return facts.where(F.col(key).isNotNull()).select(key, "entity", "ts", (F.col("ts") - before).alias("gap"))


def _extremes() -> list:
    return [F.first("entity").alias("entity"), F.count("*").alias("n_revisions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]


def _aged(chains: DataFrame, now: float, min_revisions: int) -> DataFrame:
    """Chains long enough, with their age and their mean interval: the intervals of a chain add up to its span."""
    chains = chains.where(F.col("n_revisions") >= min_revisions).withColumn("age", F.lit(float(now)) - F.col("last_ts"))
    chains = chains.withColumn("gap_sum", F.col("last_ts") - F.col("first_ts")).withColumn("gap_count", F.col("n_revisions") - 1)
    return chains.withColumn("mean_interval", F.when(F.col("gap_count") > 0, F.col("gap_sum") / F.col("gap_count")))


def volatility(facts: DataFrame, now: float, min_revisions: int = 2, key: str = _KEY, with_intervals: bool = False) -> DataFrame:
    """One row a chain of at least ``min_revisions`` rows, its age and intervals, the longest unchanged first.

    A chunk counts as a row of its own, with an interval of zero to the chunks of its document. The median
    needs every interval of a chain in order; all else is sums and extremes (:func:`staleness` uses only those).
    """
    listed = [F.array_sort(F.collect_list("gap")).alias("intervals")] if with_intervals else []
    chains = intervals(facts, key).groupBy(key).agg(*_extremes(), F.median("gap").alias("median_interval"), *listed)
    return _aged(chains, now, min_revisions).orderBy(F.col("age").desc(), key)


def staleness(facts: DataFrame, now: float, shrink: float = 1.0, min_revisions: int = 2, assume_memoryless: bool = False, key: str = _KEY) -> DataFrame:
    """A chain's age with its rate of change, shrunk towards that of chains of the same attribute, and what follows from it.

    ``p_superseded`` is null unless the process may be taken as memoryless. Chains are partial aggregates,
    without a window; the pool of an attribute is a sum over its chains.
    """
    chains = _aged(facts.where(F.col(key).isNotNull()).groupBy(key).agg(*_extremes()), now, min_revisions)
    inverse = lambda s, n: F.when(s > 0, n / s)  # noqa: E731  one over the mean
    pool = chains.groupBy("entity").agg(F.sum("gap_sum").alias("pool_sum"), F.sum("gap_count").alias("pool_count"))
    whole = pool.agg(F.sum("pool_sum").alias("all_sum"), F.sum("pool_count").alias("all_count"))
    own, prior = inverse(F.col("gap_sum"), F.col("gap_count")), F.coalesce(inverse(F.col("pool_sum"), F.col("pool_count")), inverse(F.col("all_sum"), F.col("all_count")))
    # ``whole`` is one row; ``pool`` has one row an attribute and is joined by Spark's own choice
    rows = chains.join(pool, chains["entity"].eqNullSafe(pool["entity"]), "left").drop(pool["entity"]).crossJoin(F.broadcast(whole))
    rate = F.coalesce((F.col("gap_count") * own + shrink * prior) / (F.col("gap_count") + shrink), own, prior)
    rows = rows.withColumn("rate", rate)
    p = 1 - F.exp(-F.col("rate") * F.greatest(F.col("age"), F.lit(0.0))) if assume_memoryless else F.lit(None).cast("double")
    rows = rows.withColumn("p_superseded", p).withColumn("model", F.lit("exponential" if assume_memoryless else "none"))
    rows = rows.withColumn("confidence", F.when(F.col("gap_count") <= 1, "prior").when(F.col("gap_count") <= 3, "weak").otherwise("observed"))
    worth = F.coalesce("p_superseded", F.col("age") * F.coalesce("rate", F.lit(0.0)))
    return rows.drop("pool_sum", "pool_count", "all_sum", "all_count").orderBy(worth.desc(), F.col("age").desc(), key)


def inspect_sources(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source").agg(F.count("*").alias("n"))


#: Metadata that profiles leave out (fixed values).
UNPROFILED = ("is_code", "is_chunked", "timestamp", "start_line", "end_line")


def inspect_metadata(facts: DataFrame, column: str = "metadata") -> DataFrame:
    """``(key, value, n)`` over the metadata's entries."""
    entries = facts.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return entries.where(~F.col("key").isin(*UNPROFILED)).groupBy("key", "value").agg(F.count("*").alias("n"))


def stats(facts: DataFrame) -> DataFrame:
    """One row: rows, documents (chunks of one parent count once), chains, attributes, time range, text size."""
    document = F.coalesce(F.get_json_object("metadata", "$.parent_id"), "doc_id")
    return facts.agg(
        F.count("*").alias("n_rows"), F.countDistinct(document).alias("n_documents"), F.countDistinct("group_key").alias("n_groups"), F.countDistinct("entity").alias("n_entities"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.length("text")).alias("n_chars"),
    )
