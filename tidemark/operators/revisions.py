"""Revision chains: numbering, order, supersession, current values, histories.

A chain is the rows of one ``group_key``. Every operator is a window over the chain or a partially
aggregated extreme of it; rows without a key belong to no chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = "group_key"


def auto_revision(facts: DataFrame, key: str = _KEY, arrival: str = "row_id", given: str | None = None, base: str | None = None) -> DataFrame:
    """``revision`` by arrival within the chain: one more than the highest before it, from 1; rows of no chain get 1.

    A row with a number in the column ``given`` keeps it, and numbering goes on from the highest so far;
    ``base`` names a column with the chain's highest stored revision. With A the automatic rows so far, an
    automatic row has A + max(base, the largest given - A before it): two running values, no fold.
    """
    by = Window.partitionBy(key).orderBy(arrival)
    start = F.lit(0) if base is None else F.coalesce(F.col(base), F.lit(0))
    if given is None:
        number = start + F.row_number().over(by)
    else:
        so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        automatic = F.sum(F.col(given).isNull().cast("int")).over(so_far)
        facts = facts.withColumn("__auto", automatic)
        highest = F.max(F.col(given) - F.col("__auto")).over(by.rowsBetween(Window.unboundedPreceding, -1))
        number = F.coalesce(F.col(given), F.col("__auto") + F.greatest(start, F.coalesce(highest, F.lit(0))))
    alone = F.lit(1) if given is None else F.coalesce(F.col(given), F.lit(1))
    return facts.withColumn("revision", F.when(F.col(key).isNull(), alone).otherwise(number).cast("int")).drop("__auto")


def concordance(facts: DataFrame, key: str = _KEY) -> DataFrame:
    """``(group_key, n, concordant)``: whether time never runs backwards in revision order."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("revision", "row_id"))
    rows = facts.where(F.col(key).isNotNull()).withColumn("__ok", F.coalesce(F.col("ts") >= before, F.lit(True)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bool_and("__ok").alias("concordant"))


def supersession(facts: DataFrame, order: str = "revision", key: str = _KEY) -> DataFrame:
    """Adds ``superseded`` and ``superseded_at``, the moment of the immediate successor.

    ``order='revision'`` compares (revision, ts), ``'time'`` (ts, revision). A row is superseded if its
    chain has a strictly greater pair; rows with equal pairs share their successor. Rows of no chain
    have null in both.
    """
    pair = ("revision", "ts") if order == "revision" else ("ts", "revision")
    here = F.struct(*pair)
    down = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in pair])
    # newest first: the row before is the successor, unless it has the same pair and so the same successor
    rows = facts.withColumn("__up", F.lag(here).over(down))
    step = F.when(F.col("__up").isNull() | (F.col("__up") != here), F.struct(F.col("__up.ts").alias("at")))
    after = F.last(step, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = F.col(key).isNotNull()
    rows = rows.withColumn("superseded_at", F.when(chained, after["at"])).withColumn("superseded", F.when(chained, F.col("superseded_at").isNotNull()))
    return rows.drop("__up")


def supersession_by_window(facts: DataFrame, order: str = "revision", key: str = _KEY) -> DataFrame:
    """:func:`supersession` where no two rows of a chain share a pair: one window, no join."""
    pair = ("revision", "ts") if order == "revision" else ("ts", "revision")
    after = F.lead("ts").over(Window.partitionBy(key).orderBy(*pair))
    chained = F.col(key).isNotNull()
    return facts.withColumn("superseded_at", F.when(chained, after)).withColumn("superseded", F.when(chained, F.col("superseded_at").isNotNull()))


def _ranked(facts: DataFrame, key: str) -> DataFrame:
    """Chains with ``__new``, the place from the newest, by the revision where it agrees with time, else by time."""
    agreed = concordance(facts, key).select(key, "concordant")
    rows = facts.where(F.col(key).isNotNull()).join(agreed, key)
    counted = F.when(F.col("concordant"), F.col("revision")).otherwise(F.lit(0))
    newest = Window.partitionBy(key).orderBy(counted.desc(), F.col("ts").desc(), F.col("row_id").desc())
    return rows.withColumn("__new", F.row_number().over(newest))


def member(facts: DataFrame, which: str, key: str = _KEY) -> DataFrame:
    """One row a chain: its ``current``, ``previous`` (a chain of one: itself) or ``oldest`` member."""
    rows = _ranked(facts, key)
    size = F.count("*").over(Window.partitionBy(key))
    place = {"current": F.lit(1), "previous": F.least(F.lit(2), F.col("__n")), "oldest": F.col("__n")}[which]
    return rows.withColumn("__n", size).where(F.col("__new") == place).drop("__n", "__new", "concordant")


def current_value(facts: DataFrame, columns: list[str], as_of: float | None = None, key: str = _KEY) -> DataFrame:
    """One row a chain: ``columns`` of its latest row by (ts, revision), of those known at ``as_of``. A partial aggregate."""
    seen = facts.where(F.col(key).isNotNull()) if as_of is None else facts.where(F.col(key).isNotNull() & (F.col("ts") <= as_of))
    latest = F.max(F.struct("ts", "revision", *[c for c in columns if c not in ("ts", "revision")])).alias("__row")
    return seen.groupBy(key).agg(latest).select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])


def group_extremes(facts: DataFrame, key: str = _KEY) -> DataFrame:
    """``(group_key, max_revision, max_ts, declared)`` of every chain."""
    return facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("revision").alias("max_revision"), F.max("ts").alias("max_ts"), F.bool_or("declared").alias("declared"))


def history(facts: DataFrame, max_len: int | None = None, key: str = _KEY) -> DataFrame:
    """Every chain oldest first: ``position`` from 1 and ``superseded`` (all but the last). ``max_len`` keeps the newest."""
    rows = _ranked(facts, key)
    kept = rows if max_len is None or max_len < 0 else rows.where(F.col("__new") <= max_len)
    size = F.count("*").over(Window.partitionBy(key))
    return kept.withColumn("position", (size - F.col("__new") + 1).cast("int")).withColumn("superseded", F.col("__new") > 1).drop("__new", "concordant")
