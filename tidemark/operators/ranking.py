"""The ranking layer: which of several competing statements a question should get first.

The layer works on the scored candidates of one question. Its inputs are a few scalars taken in one
aggregate (best cosines, the best row's attribute, whether a declared group is present), decisions on
the driver over distinct attribute names, and column arithmetic. Every step is an addition, so
``0 <= score - cosine <= MAX_BOOST``, and a store without tagged rows keeps its plain cosines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import attributes as A
from tidemark.functions import fixed as K
from tidemark.functions.text import revision_marker
from tidemark.operators.vectors import dot
from tidemark.runtime import ship_package

MAX_BOOST = K.INTENT_BOOST + K.GROUP_HOIST + K.REVISION_LEAD


@dataclass
class Settings:
    intent_margin: float = K.INTENT_MARGIN
    intent_boost: float = K.INTENT_BOOST
    group_hoist: float = K.GROUP_HOIST
    revision_lead: float = K.REVISION_LEAD
    group_floor: float = K.GROUP_FLOOR
    window_delta: float = K.WINDOW_DELTA
    window_max: int = K.WINDOW_MAX
    window_sim: float = K.WINDOW_SIM
    historical_mode: str = "oldest"
    personal_sources: tuple[str, ...] = field(default_factory=lambda: tuple(K.PERSONAL_SOURCES.split()))


class Names:
    """The attribute names of a store. They may be many, so only those that match a wanted name are ever brought to the driver."""

    def __init__(self, facts: DataFrame):
        self.rows = facts.where(F.col("entity").isNotNull() & (F.col("entity") != "")).select("entity")
        self._any: bool | None = None
        self._found: dict[str, list[str]] = {}

    def __bool__(self) -> bool:
        if self._any is None:
            self._any = not self.rows.isEmpty()
        return self._any

    def matching(self, *wanted: str | None) -> list[list[str]]:
        """The stored names that mean the same as each wanted one, in order; one pass for all that are not known yet."""
        new = [w for w in dict.fromkeys(wanted) if w and w not in self._found]
        if new:
            ship_package(self.rows.sparkSession)

            def run(batches):
                for batch in batches:
                    names = batch.column(0).to_pylist()
                    pairs = [(w, n) for w in new for n in A.matching_names(w, names)]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.string())], ["wanted", "name"])

            got = self.rows.distinct().mapInArrow(run, "wanted string, name string").collect()
            self._found |= {w: sorted(r.name for r in got if r.wanted == w) for w in new}
        return [self._found[w] if w else [] for w in wanted]


def question_words(question: str) -> frozenset[str]:
    """The words of a question that may be a name."""
    return frozenset(A.re.findall("[a-zÀ-ɏ]{3,}", A.fold(question).lower()))


def owner_names(facts: DataFrame, question: str) -> frozenset[str]:
    """The words of the question that are tokens of a name which the store's ``name`` rows state.

    All ``name`` rows are read where they lie; what reaches the driver is bounded by the question.
    """
    words = question_words(question)
    if not words:
        return frozenset()
    ship_package(facts.sparkSession)

    def run(batches):
        met = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                met |= words & A.self_name_tokens(text)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["word"])

    texts = facts.where((F.col("entity") == "name") & F.col("text").isNotNull()).select("text")
    return frozenset(r.word for r in texts.mapInArrow(run, "word string").distinct().collect())


def intents_of(question: str, names: Names, owners: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """The attribute that a question is about and the stored names that match it: the first guess the store knows, else the first."""
    guesses = A.query_intents(question, bool(question_words(question) & owners))
    for guess, known in zip(guesses, names.matching(*guesses), strict=True):
        if known:
            return guess, known
    return (guesses[0], []) if guesses else (None, [])


def intent_boost(entity: Column, names: list[str], weight: float = K.INTENT_BOOST) -> Column:
    return F.when(entity.isin(names), F.lit(weight)).otherwise(F.lit(0.0)) if names else F.lit(0.0)


def relevance_floor(rows: DataFrame, member: Column, delta: float = K.GROUP_FLOOR) -> DataFrame:
    """Adds ``in_group``: members whose cosine is within ``delta`` of the best member's (one number, found first)."""
    best = rows.agg(F.max(F.when(member, F.col("cosine"))).alias("best")).first().best
    inside = F.lit(False) if best is None else F.coalesce(member & (F.col("cosine") >= best - delta), F.lit(False))
    return rows.withColumn("in_group", inside)


def lead(rows: DataFrame, winner: Column, group: Column, weight: float = K.REVISION_LEAD, top: float | None = None) -> DataFrame:
    """Raises the winner's ``final`` to just above the best of its group, by at most ``weight``. ``top``: that best, if it is known."""
    if top is None:
        top = rows.agg(F.max(F.when(group, F.col("final"))).alias("top")).first().top
    lift = F.least(F.greatest(F.lit(top) - F.col("final") + K.LEAD_STEP, F.lit(0.0)), F.lit(weight))
    return rows.withColumn("final", F.when(winner, F.col("final") + F.coalesce(lift, F.lit(0.0))).otherwise(F.col("final")))


def cosine_window(rows: DataFrame, settings: Settings | None = None) -> list[dict]:
    """The few best candidates that may state one fact: near the best in cosine, alike, not tagged as something else.

    Collects at most ``window_max`` rows.
    """
    s = settings or Settings()
    near = rows.orderBy(F.col("cosine").desc(), "row_id").limit(s.window_max).withColumn("marked", revision_marker(F.col("text")))
    got = [r.asDict() for r in near.select("row_id", "cosine", "entity", "source", "marked", "embedding").orderBy(F.col("cosine").desc(), "row_id").collect()]
    got = [r for r in got if r["cosine"] >= got[0]["cosine"] - s.window_delta]
    first = got[0] if got else None
    kept = []
    for r in got:
        other = bool(first["entity"]) and bool(r["entity"]) and not A.entities_match(first["entity"], r["entity"])
        revisable = bool(r["entity"]) or r["source"] in s.personal_sources
        if r is first or (not other or r["marked"]):
            if revisable:
                kept.append(r)
    if kept:
        lead_vector = kept[0]["embedding"]
        kept = [r for r in kept if sum(float(a) * float(b) for a, b in zip(r["embedding"], lead_vector, strict=True)) >= s.window_sim]
    return kept


def chosen_entity(best: str | None, top: float | None, mine: float | None, intent: str | None, known: list[str], margin: float) -> str | None:
    """The attribute the answer is about: the intent if the store holds it and it does not lose by more than the margin, else the best row's."""
    if intent and known:
        return best if best and best != intent and mine is not None and top - mine > margin else intent
    return best or intent


def best_entity(score: Column) -> Column:
    """The attribute of the best row, ties to the lower row id."""
    return F.max_by("entity", F.struct(score.alias("s"), (-F.col("row_id")).alias("r")))


def top_entity(rows: DataFrame, intent: str | None, known: list[str], margin: float) -> str | None:
    """:func:`chosen_entity` over rows with ``final`` and ``cosine``, by one aggregate."""
    mine = F.max(F.when(F.col("entity").isin(known), F.col("cosine"))) if known else F.lit(None).cast("double")
    got = rows.agg(best_entity(F.col("final")).alias("entity"), F.max("cosine").alias("top"), mine.alias("mine")).first()
    return chosen_entity(got.entity, got.top, got.mine, intent, known, margin)


def rank(candidates: DataFrame, question: str, names: Names, direction: str = "current", owners: frozenset[str] = frozenset(), settings: Settings | None = None) -> DataFrame:
    """Adds ``final`` to masked candidates ``(row_id, cosine, base, entity, group_key, revision, ts, declared, source, text, embedding)``.

    Everything that depends on all candidates is a scalar of one of at most four aggregates; no window
    spans the candidates.
    """
    s = settings or Settings()
    personal = bool(names)
    rows = candidates
    if not personal and not A.is_explicit_history(direction):
        return rows.withColumn("final", F.col("base"))
    intent, known = intents_of(question, names, owners) if personal else (None, [])
    boosted = F.col("base") + intent_boost(F.col("entity"), known, s.intent_boost)
    mine = F.max(F.when(F.col("entity").isin(known), F.col("cosine"))) if known else F.lit(None).cast("double")
    # the best row with and without the boost: which of them counts is known only after the margin
    first = rows.agg(F.max("cosine").alias("top"), mine.alias("mine"), best_entity(boosted).alias("with_boost"), best_entity(F.col("base")).alias("plain")).first()
    best = first.with_boost
    if known and first.mine is not None and first.top - first.mine > s.intent_margin:
        intent, known, boosted, best = None, [], F.col("base"), first.plain
    rows = rows.withColumn("final", boosted)
    top = chosen_entity(best, first.top, first.mine, intent, known, s.intent_margin)
    members = names.matching(top)[0]
    tagged = F.col("entity").isin(members) if members else F.lit(False)
    by_wording = A.temporal_question(question, direction, intent, personal)
    found = rows.where(tagged).agg(
        F.count("*").alias("n"), F.min_by("declared", "row_id").alias("declared"), F.count_distinct("group_key").alias("keys"), F.count("group_key").alias("keyed"),
        F.max(F.struct("ts", "revision")).alias("latest"), F.max("cosine").alias("best"),
    ).first()
    if not by_wording and not (found.n >= 2 and found.declared):
        return rows
    historical, mode = A.resolve_direction(direction, question, s.historical_mode)
    if historical and not A.is_explicit_history(direction) and not personal:
        return rows
    group, state = F.lit(False), None
    if found.n:
        group = tagged & (F.col("cosine") >= found.best - s.group_floor)
        if by_wording and found.declared and found.keys == 1 and found.keyed == found.n:
            group = group | (tagged & (F.col("ts") == found.latest.ts) & (F.col("revision") == found.latest.revision))
        state = group_state(rows.where(group))
    if intent and state and state.n:
        rows = rows.withColumn("final", F.when(group, F.col("final") + s.group_hoist).otherwise(F.col("final")))
    if state is None or state.n < 2:
        window = [r["row_id"] for r in cosine_window(rows, s)]
        if len(window) < 2:
            return rows
        group = F.col("row_id").isin(window)
        state = group_state(rows.where(group))
        hoisted = 0.0
    else:
        hoisted = s.group_hoist if intent else 0.0
    # every member gets the group's largest boost, so the best of the group is its best base raised by that
    boost = state.boost + hoisted
    rows = rows.withColumn("final", F.when(group, F.col("base") + F.lit(boost)).otherwise(F.col("final")))
    winner = winning_row(rows.where(group), historical, mode, state)
    return lead(rows, F.col("row_id") == winner, group, s.revision_lead, state.base + boost)


def group_state(group: DataFrame):
    """One row about a group: ``n``, ``keys``, ``keyed``, its best ``base`` and its largest ``boost`` so far."""
    return group.agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("keys"), F.count("group_key").alias("keyed"), F.max("base").alias("base"), F.max(F.col("final") - F.col("base")).alias("boost")).first()


#: Revisions that one task orders when a chain's agreement with time is checked.
REVISION_BIN = 1 << 16


def concordant(chain: DataFrame) -> bool:
    """Whether time never runs backwards in the (revision, row_id) order of one chain, checked by ranges of revisions."""
    part = F.floor(F.col("revision") / REVISION_BIN).alias("part")
    place = F.struct("revision", "row_id")
    rows = chain.select(part, "ts", "revision", "row_id")
    rows = rows.withColumn("ok", F.coalesce(F.col("ts") >= F.lag("ts").over(Window.partitionBy("part").orderBy("revision", "row_id")), F.lit(True)))
    parts = rows.groupBy("part").agg(F.bool_and("ok").alias("ok"), F.min_by("ts", place).alias("first_ts"), F.max_by("ts", place).alias("last_ts"))
    joined = F.coalesce(F.col("first_ts") >= F.lag("last_ts").over(Window.orderBy("part")), F.lit(True))  # one row a range
    return bool(parts.select((F.col("ok") & joined).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first().ok)


def winning_row(group: DataFrame, historical: bool, mode: str, state=None) -> int:
    """The row id of the member asked for. Revisions count only within one key and where they agree with time."""
    state = state or group.agg(F.count_distinct("group_key").alias("keys"), F.count("group_key").alias("keyed"), F.count("*").alias("n")).first()
    counted = state.keys == 1 and state.keyed == state.n and concordant(group)
    order = [F.col(c) for c in (["revision"] if counted else []) + ["ts", "row_id"]]
    if historical and mode != "previous":
        return group.orderBy(*[c.asc() for c in order]).select("row_id").first().row_id
    newest = [r.row_id for r in group.orderBy(*[c.desc() for c in order]).select("row_id").limit(2).collect()]
    return newest[-1] if historical else newest[0]


def similarity(facts: DataFrame, leader: list[float], column: str = "embedding") -> DataFrame:
    return facts.withColumn("to_leader", dot(F.col(column), F.array(*[F.lit(float(x)) for x in leader])))


def temporal_prior(rows: DataFrame, weight: float, historical: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds ``prior``: up to ``weight`` for the latest of the candidates by (revision, ts), or for the earliest. Off by default in :func:`rank`.

    ``by`` names the columns of a question or chain within which places count (default: the chain).
    """
    place = F.percent_rank().over(Window.partitionBy(*(by or ["group_key"])).orderBy("revision", "ts"))
    return rows.withColumn("prior", weight * ((1 - place) if historical else place))
