"""Composite queries: search, decomposed and two-hop search, histories of a question, federation, context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed as K
from tidemark.functions.text import decompose_query, word_count
from tidemark.operators import ranking, revisions
from tidemark.operators.filters import matches
from tidemark.operators.vectors import checked_query, dot, legacy_score, literal_vector, top_k

HIT = ["doc_id", "text", "source", "metadata", "score", "cosine", "ts", "revision", "superseded", "superseded_at"]


def candidates(facts: DataFrame, query: list[float], min_score: float = 0.0, as_of: float | None = None, where: dict | None = None, score_mode: str = "cosine") -> DataFrame:
    """Rows that may answer, with ``cosine`` and ``base``: floor on the base score, moment, metadata. All filters precede ranking."""
    rows = facts if as_of is None else facts.where(F.col("ts") <= as_of)
    if where is not None:
        rows = rows.where(matches(F.col("metadata"), where))
    rows = rows.withColumn("cosine", dot(F.col("embedding"), literal_vector(query)))
    rows = rows.withColumn("base", legacy_score(F.col("cosine")) if score_mode == "legacy" else F.col("cosine"))
    return rows.where(F.col("base") >= min_score)


def search(facts: DataFrame, question: str, query, k: int = 3, min_score: float = 0.0, as_of: float | None = None, where: dict | None = None, direction: str = "current", score_mode: str = "cosine", settings: ranking.Settings | None = None) -> DataFrame:
    """The k best hits of one question, ranked by the revision layer and labelled by what replaced them.

    Attribute names and supersession are those of the whole store, also under ``as_of``.
    """
    unit = checked_query(query)
    if unit is None or k <= 0:
        return facts.where(F.lit(False)).select(*[F.lit(None).cast("double").alias(c) if c in ("score", "cosine", "superseded_at") else F.lit(None).cast("boolean").alias(c) if c == "superseded" else F.col(c) for c in HIT])
    names = ranking.Names(facts)
    rows = candidates(facts, unit, min_score, as_of, where, score_mode)
    ranked = ranking.rank(rows, question, names, direction, ranking.owner_names(facts, question), settings)
    best = top_k(ranked.withColumnRenamed("final", "score"), "score", k)
    # k rows: their chains are found by a broadcast of k keys
    chains = facts.join(F.broadcast(best.where(F.col("group_key").isNotNull()).select("group_key").distinct()), "group_key", "left_semi")
    later = chains.select(F.col("group_key").alias("c_key"), F.col("revision").alias("c_rev"), F.col("ts").alias("c_ts"))
    after = (F.col("c_key") == F.col("group_key")) & (F.struct("c_rev", "c_ts") > F.struct("revision", "ts"))
    keyed = best.join(later, after, "left").groupBy("row_id").agg(F.min(F.struct("c_rev", "c_ts")).alias("next"))
    hits = best.join(F.broadcast(keyed), "row_id")
    hits = hits.withColumn("superseded_at", F.col("next.c_ts")).withColumn("superseded", F.when(F.col("group_key").isNotNull(), F.col("next.c_ts").isNotNull()))
    return hits.orderBy(F.col("score").desc(), "row_id").select(*HIT, "row_id")


def summary(facts: DataFrame, query, k: int = 3, min_score: float = 0.0, **scope) -> dict:
    """``n_above_floor``, ``returned`` and ``truncated`` of a search, counted in one pass. Filtered searches report the true count."""
    unit = checked_query(query)
    n = candidates(facts, unit, min_score, **scope).count() if unit else 0
    return {"top_k": k, "floor": min_score, "n_above_floor": n, "returned": min(n, max(0, k)), "truncated": n > max(0, k)}


def explain(found: dict) -> str:
    """What a summary means, in words."""
    text = f"{found['returned']} of {found['n_above_floor']} matching records returned"
    if found["floor"] > 0:
        text += f", all at or above {found['floor']:.2f}"
    return text + (f"; raise top_k above {found['top_k']} to see the rest." if found["truncated"] else ".")


def clauses(question: str) -> list[str]:
    """The parts that a question is searched by; the whole of it where it has too many."""
    whole = str(question or "").strip()
    parts = decompose_query(whole)
    return parts if 1 < len(parts) <= K.MAX_CLAUSES else [whole] if whole else []


def interleave(hits: DataFrame, k: int) -> DataFrame:
    """Merges ``(sub, depth, score, text, ...)``: by depth, within one by score then sub-question; a text counts once; k rows."""
    order = [F.col("depth").asc(), F.col("score").desc(), F.col("sub").asc()]
    one = hits.withColumn("__n", F.row_number().over(Window.partitionBy("text").orderBy(*order))).where("__n = 1").drop("__n")
    return one.orderBy(*order).limit(k)


def unanswered(subs: DataFrame, hits: DataFrame) -> DataFrame:
    """Sub-questions of which no hit was returned."""
    return subs.join(hits.select("sub").distinct(), "sub", "left_anti")


def search_decomposed(facts: DataFrame, question: str, embedder, k: int = 3, **options) -> DataFrame:
    """Search by clause, merged round by round; every sub-question takes at least two hits."""
    parts, found = clauses(question), None
    for at, part in enumerate(parts):
        hits = search(facts, part, embedder.embed(part), max(2, k), **options)
        place = Window.orderBy(F.col("score").desc(), "row_id")  # max(2, k) rows
        hits = hits.withColumn("sub", F.lit(at)).withColumn("depth", F.row_number().over(place))
        found = hits if found is None else found.unionByName(hits)
    return search(facts, question, embedder.embed(question), k, **options) if found is None or len(parts) < 2 else interleave(found, k)


def text_bridge(embedder, question: str, anchor: str):
    return embedder.embed(f"{question}\n{anchor}") if anchor else None


def multihop(facts: DataFrame, question: str, embedder, k: int = 3, bridge=None, **options) -> DataFrame:
    """Two hops: the first pass's best text, joined to the question, is searched anew; both passes share the places."""
    first = search(facts, question, embedder.embed(question), k, **options)
    anchor = first.limit(1).collect()
    own, other = -(-k // 2), k // 2
    vector = (bridge or text_bridge)(embedder, question, anchor[0].text) if anchor and other else None
    if vector is None:
        return first.withColumn("hop", F.lit(1))
    second = search(facts, question, vector, k + other + 2, **options)
    place = Window.orderBy(F.col("score").desc(), "row_id")  # a few rows
    a = first.withColumn("at", F.row_number().over(place)).withColumn("hop", F.lit(1))
    b = second.withColumn("at", F.row_number().over(place)).withColumn("hop", F.lit(2))
    turn = F.when((F.col("hop") == 1) & (F.col("at") <= own), 0).when(F.col("hop") == 2, 1).otherwise(2)
    both = a.unionByName(b).withColumn("turn", turn)
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "at"))).where("__n = 1")
    chosen = one.orderBy("turn", "at").limit(k).withColumn("anchor_id", F.when(F.col("hop") == 2, F.lit(anchor[0].doc_id)))
    return chosen.orderBy(F.col("cosine").desc(), "row_id").drop("at", "turn", "__n")


def history(facts: DataFrame, question: str, query, max_len: int | None = None, min_score: float = 0.0, settings: ranking.Settings | None = None) -> DataFrame:
    """The chain that a question is about, oldest first, within the best row's own group."""
    s = settings or ranking.Settings()
    unit = checked_query(query)
    rows = candidates(facts, unit, -2.0) if unit else facts.withColumn("cosine", F.lit(0.0)).withColumn("base", F.lit(0.0)).where(F.lit(False))
    masked = rows.where(F.col("base") >= min_score)
    names = ranking.Names(facts)
    intent, known = ranking.intents_of(question, names) if names else (None, [])
    best = masked.orderBy(F.col("base").desc(), "row_id").limit(1).select("row_id", "group_key").collect()
    if not best:
        return rows.withColumn("superseded", F.lit(False))
    top = ranking.top_entity(masked.withColumn("final", F.col("base")), intent, known, s.intent_margin)
    members = names.matching(top)[0]
    group = rows.where(F.col("entity").isin(members)) if members else rows.where(F.lit(False))
    if group.limit(2).count() < 2:
        window = [r["row_id"] for r in ranking.cosine_window(masked, s)]
        group = rows.where(F.col("row_id").isin(window or [best[0].row_id]))
    if best[0].group_key is not None:
        own = group.where(F.col("group_key") == best[0].group_key)
        group = group if own.isEmpty() else own
    keyed = group.withColumn("__chain", F.lit("one"))
    # the revision orders the chain only if it is of one key
    one_key = group.agg(F.count_distinct("group_key").alias("n"), F.count("group_key").alias("keyed"), F.count("*").alias("rows")).first()
    if one_key.n != 1 or one_key.keyed != one_key.rows:
        keyed = keyed.withColumn("__revision", F.col("revision")).withColumn("revision", F.lit(0))
        return revisions.history(keyed, max_len, "__chain").withColumn("revision", F.col("__revision")).drop("__chain", "__revision").orderBy("position")
    return revisions.history(keyed, max_len, "__chain").drop("__chain").orderBy("position")


def federated(stores: dict[str, DataFrame], query: list[float], k: int, column: str = "embedding") -> DataFrame:
    """Each store's k best with the store's name, merged by score, cut to k."""
    found = None
    for name, facts in stores.items():
        best = top_k(facts.withColumn("cosine", dot(F.col(column), literal_vector(query))), "cosine", k).withColumn("store", F.lit(name))
        found = best if found is None else found.unionByName(best)
    return found.orderBy(F.col("cosine").desc(), "store", "row_id").limit(k)


def context_budget(hits: DataFrame, words: int, order: list[str], by: list[str]) -> DataFrame:
    """Hits in order while their words fit the budget; the first is always kept. Adds ``n_words`` and ``words_before``."""
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hits.withColumn("n_words", word_count(F.col("text"))).withColumn("words_before", before)
    return rows.where((F.col("words_before") == 0) | (F.col("words_before") + F.col("n_words") <= words))
