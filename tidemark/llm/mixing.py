"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words. A document's copies are first the whole part of its
source's target over the source's size, taken for certain. What is left of the target is drawn
without replacement by Pareto order sampling with unequal probabilities: a document's inclusion odds are
p/(1-p) = theta * g, where g grows with its length (``temper``) and theta, one a source, is solved so
that the expected words meet what is left. Documents are ranked by random odds over inclusion odds,
u/(1-u) : p/(1-p). The sample's size is fixed in words: documents are taken in rank order up to the
source's remaining words; a document too long for what is left is passed over, and at the end one
that crosses the edge is taken if that comes nearer.

Rows equal in id and text are first counted, then dealt out again as numbered copies with random
numbers of their own: a tie is cut inside, and however many rows repeat, no task holds them all.

No source is ever gathered in one task. Ranks are summed into ``BINS`` bins of a source with map-side
sums, and only the documents of the one bin that holds the edge are ordered. Repeated rounds fill what an
overlong document at the edge left open. A round ends in one cut a source, so documents are never
joined with documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_RE, materialize

#: Bins into which a source's ranks are cut.
BINS = 1 << 14
#: Copies of a row that one task deals out at once.
CHUNK = 4096
#: Steps of g, four to a doubling, either way from a source's mean length.
STEPS = 12


def targets(totals: DataFrame, weights: tuple[float, ...], max_repeat: float, share: float = 1.0) -> DataFrame:
    """``(source, source_size, target)`` and the other columns of ``totals``, one row a source.

    Sources in code point order (null last) take ``weights`` in turn and share ``share`` of all words
    by weight. A target stops at ``max_repeat`` times its source; the excess is dealt anew by weight
    among the others. Places come from a range partition and its offsets; the common level per unit of
    weight rises by one aggregate a round until no further source stops below it. No window spans
    all sources.
    """
    parts = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(totals.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = ranged.withColumn("place", inside).join(F.broadcast(offsets), "part")
    one = placed.withColumn("w", F.element_at(cycle, ((F.col("place") + F.col("before") - 1) % len(weights) + 1).cast("int")))
    one = materialize(one.withColumn("limit", F.col("source_size") * F.lit(float(max_repeat))).drop("part", "place", "before"), "weighted")
    words = (one.agg(F.sum("source_size").alias("n")).first().n or 0) * share
    level = 0.0
    while True:
        stops = F.col("limit") < F.lit(level) * F.col("w")
        got = one.agg(F.sum(F.when(stops, F.col("limit"))).alias("stopped"), F.sum(F.when(~stops, F.col("w"))).alias("w")).first()
        if got.w is None:
            level = None  # every source stops
            break
        higher = (words - (got.stopped or 0.0)) / got.w
        if higher <= level:
            break
        level = higher
    target = F.col("limit") if level is None else F.least("limit", F.lit(level) * F.col("w"))
    return one.withColumn("target", target).drop("w", "limit")


def _units(docs: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, source, size, tag)``: one row per row; ``tag`` is random by id, text and, among equal rows, a number."""
    text = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"), text.alias("row"))
    classes = sized.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n"))
    few = classes.where(F.col("n") <= CHUNK).withColumn("start", F.lit(0).cast("long"))
    many = classes.where(F.col("n") > CHUNK).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "start")
    dealt = few.unionByName(many).withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK, F.col("n")) - 1)))
    return dealt.select("doc_id", "source", "size", F.xxhash64("row", "copy").alias("tag"))


def _theta(words_by_step, goal):
    """theta with sum of words * theta g / (1 + theta g) equal to ``goal``, by bisection over an array of ``(step, words)``."""
    met = lambda theta: F.aggregate(words_by_step, F.lit(0.0), lambda acc, x: acc + x["words"] * (theta * F.pow(F.lit(2.0), x["step"] / 4) / (1 + theta * F.pow(F.lit(2.0), x["step"] / 4))))
    ends = F.struct(F.lit(-40.0).alias("low"), F.lit(40.0).alias("high"))

    def halve(acc, _):
        middle = (acc["low"] + acc["high"]) / 2
        short = met(F.exp(middle)) < goal
        return F.struct(F.when(short, middle).otherwise(acc["low"]).alias("low"), F.when(short, acc["high"]).otherwise(middle).alias("high"))

    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(50)), ends, halve, lambda acc: acc["high"]))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = 3, seed: int = 17, rounds: int = 4, share: float = 1.0, temper: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, copies, inclusion``.

    ``size`` counts words of the whole text (null: 0); ``taken`` is ``copies * size``, copies at most
    ``max_repeat``; ``inclusion`` is the probability of the copy beyond the certain ones. Random
    numbers come from hashes of id, text and copy, so reruns agree. Of rows equal in id and text some
    may be taken and others not; how many is fixed, which of them has no meaning. Sources without
    words have target 0. Null sources are a source of their own. Other columns are ignored; an empty
    table gives no rows.
    """
    sized = materialize(_units(docs, seed), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("held"))
    goal = materialize(targets(totals, weights, max_repeat, share), "targets")
    small = _small(goal)  # no table with a row a source is larger than this one
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", F.least(rate, F.lit(float(max_repeat)))).withColumn("sure", F.floor("rate").cast("long"))
    goal = goal.withColumn("room", F.col("target") - F.col("sure") * F.col("source_size"))
    longer = F.when((F.col("size") > 0) & (F.col("held") > 0), F.round(4 * temper * F.log2(F.col("size") * F.col("held") / F.col("source_size")))).otherwise(F.lit(0.0))
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), longer.cast("int")))
    stepped = _by_source(sized, goal.select("source", "source_size", "held"), small).withColumn("step", step)
    steps = stepped.where("size > 0").groupBy("source", "step").agg(F.sum("size").alias("words"))
    steps = steps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("step", "words"))).alias("steps"))  # 2 * STEPS + 1 at most
    may = (F.col("sure") < max_repeat) & (F.col("room") > 0)
    goal = _by_source(goal, steps, small, "left").withColumn("theta", F.when(may, _theta(F.col("steps"), F.col("room")))).drop("steps", "rate")
    goal = materialize(goal, "goal")
    u = (F.shiftrightunsigned("tag", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = F.col("theta") * F.pow(F.lit(2.0), step / 4)
    rank = (u / (1 - u)) / odds
    # rank in [0, 1): odds / (1 + odds) keeps the order; documents without a chance come last
    rank = F.coalesce(rank / (1 + rank), F.lit(1.0))
    inclusion = F.when(F.col("size") > 0, F.coalesce(odds / (1 + odds), F.lit(0.0))).otherwise(F.lit(0.0))
    ranked = _by_source(sized, goal.drop("room"), small).select("doc_id", "source", "size", "tag", "source_size", "target", "sure", rank.alias("rank"), inclusion.alias("inclusion"))
    state = materialize(ranked, "ranked").withColumn("extra", F.lit(0).cast("long"))
    room = goal.where(may).select("source", "room")
    code = F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int")
    place = F.struct("rank", "doc_id", "tag", "size")
    for turn in range(rounds):
        last = turn == rounds - 1
        # a document that crosses the edge ends the round, so after the first only short ones take part, which leave little open
        fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.lit(turn == 0) | (F.col("size") <= (2 if last else 0.25) * F.col("room")))
        open_ = _by_source(state, room, small).where(fits).withColumn("code", code)
        edge = _edge(open_)
        order = Window.partitionBy("source").orderBy(place).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inside = _by_source(open_, edge, small).where("code = edge").withColumn("to", F.col("below") + F.sum("size").over(order))
        # in the last round the document that crosses the edge is taken where that leaves the smaller error
        nearer = (F.col("to") - F.col("size") < F.col("room")) & (2 * F.col("to") - F.col("size") < 2 * F.col("room"))
        taken = inside.where((F.col("to") <= F.col("room")) | (F.lit(last) & nearer))
        # what is taken is a stretch from the front, so one cut a source tells it: no join of documents
        cut = taken.groupBy("source").agg(F.max(place).alias("upto"), F.max("to").alias("to"))
        cuts = _by_source(_by_source(room, edge, small, "left"), cut, small, "left")
        cuts = materialize(cuts.select("source", "room", "edge", "upto", F.coalesce("to", "below", "whole", F.lit(0)).alias("spent")), f"cut{turn}")
        hit = F.col("room").isNotNull() & fits & (F.col("edge").isNull() | (code < F.col("edge")) | ((code == F.col("edge")) & F.coalesce(place <= F.col("upto"), F.lit(False))))
        state = _by_source(state, cuts.drop("spent"), small, "left").withColumn("extra", F.greatest("extra", F.coalesce(hit, F.lit(False)).cast("long"))).drop("room", "edge", "upto")
        room = cuts.select("source", (F.col("room") - F.col("spent")).alias("room")).where("room > 0")
    copies = F.col("sure") + F.col("extra")
    return state.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "inclusion")


def _edge(rows: DataFrame) -> DataFrame:
    """``(source, edge, below, whole)``: the bin in which the running size reaches the room and what lies below it (null if none does), all words."""
    bins = rows.groupBy("source", "code").agg(F.sum("size").alias("in_bin"), F.first("room").alias("room"))
    run_up = Window.partitionBy("source").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("in_bin").over(run_up), F.lit(0)))
    holds = (F.col("below") < F.col("room")) & (F.col("below") + F.col("in_bin") >= F.col("room"))
    return bins.groupBy("source").agg(F.max(F.when(holds, F.col("code"))).alias("edge"), F.max(F.when(holds, F.col("below"))).alias("below"), F.sum("in_bin").alias("whole"))


def _by_source(rows: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Joins a table with one row a source, null matching null; it is broadcast if it is within the bound."""
    side = table.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether a per-source table is within the bound up to which it is broadcast."""
    return df.limit(rows + 1).count() <= rows
