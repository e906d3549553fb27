"""Live ingest: tagging, pronouns that inherit the attribute before them, and revision counters.

A user is part of every group key, so one stateful step keyed by user holds all that is needed: the
user's last attribute and the highest revision of each of the user's groups. The same fold runs on
whole tables (:func:`ingest_batch`), where the table's order is one session. Late rows are accepted as
they come; their order is repaired when chains are read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions import attributes as A
from tidemark.functions import fixed as K
from tidemark.runtime import ship_package
from tidemark.schema import with_group_key

_IN = ["row_id", "doc_id", "text", "source", "metadata", "ts", "user_id", "project", "entity"]
TAGGED = "row_id long, doc_id string, text string, source string, metadata string, ts double, user_id string, project string, entity string, declared boolean"


def tag(rows: pd.DataFrame, last: str | None, personal: frozenset[str] = frozenset(K.PERSONAL_SOURCES.split())) -> tuple[pd.DataFrame, str | None]:
    """Tags one user's rows in order. A row that names its attribute keeps it and is declared; others of a personal source are tagged."""
    entities, declared = [], []
    for r in rows.itertuples(index=False):
        given = A.normalize_entity(r.entity) if isinstance(r.entity, str) else ""
        name = given or None
        if name is None and r.source in personal:
            name = A.detect_entity(r.text)
            if name is None and last and A.is_pronoun_led(r.text):
                name = A.inherit_entity(last, r.text)
        entities.append(name)
        declared.append(bool(given))
        last = name or last
    return rows.assign(entity=pd.Series(entities, index=rows.index, dtype=object), declared=declared), last


def _marks(personal: frozenset[str]):
    """What each row says by itself: the attribute it names, whether it was given, and how it would bend an inherited one."""

    @F.pandas_udf("name string, declared boolean, bend string")
    def mark(text: pd.Series, source: pd.Series, entity: pd.Series) -> pd.DataFrame:
        rows = []
        for said, origin, given in zip(text, source, entity, strict=True):
            given = A.normalize_entity(given) if isinstance(given, str) else ""
            name, bend = given or None, None
            if name is None and origin in personal:
                name = A.detect_entity(said)
                if name is None and A.is_pronoun_led(said):
                    bend = "other" if A.is_third_party(said) else "own" if A.is_first_person(said) else "same"
            rows.append((name, bool(given), bend))
        return pd.DataFrame(rows, columns=["name", "declared", "bend"])

    return mark


def ingest_batch(rows: DataFrame, personal_sources: str = K.PERSONAL_SOURCES) -> DataFrame:
    """Tags and numbers a whole table: one session a user, revisions by arrival within a group.

    Each row is read once in Arrow batches. What a follow-up inherits is the user's last named attribute,
    bent by the last follow-up since that spoke of oneself or of others: two running values of a
    window, in the JVM, which spills where one user has very many rows.
    """
    ship_package(rows.sparkSession)
    mark = _marks(frozenset(personal_sources.split()))("text", "source", "entity")
    marked = rows.select(*_IN).withColumn("__m", mark)
    so_far = Window.partitionBy("user_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.col("__m.name").isNotNull()
    event = F.when(named, F.lit("named")).when(F.col("__m.bend").isin("other", "own"), F.col("__m.bend"))
    marked = marked.withColumn("__last", F.last("__m.name", ignorenulls=True).over(so_far)).withColumn("__event", F.last(event, ignorenulls=True).over(so_far))
    bare = F.regexp_replace("__last", "^" + K.THIRD_PARTY, "")
    bent = F.when(F.col("__event") == "other", F.concat(F.lit(K.THIRD_PARTY), bare)).when(F.col("__event") == "own", bare).otherwise(F.col("__last"))
    inherited = F.when(F.col("__m.bend").isNotNull(), F.nullif(bent, F.lit("")))
    names = [c.split()[0] for c in TAGGED.split(", ")]
    tagged = marked.withColumn("entity", F.coalesce("__m.name", inherited)).withColumn("declared", F.col("__m.declared")).select(names)
    tagged = with_group_key(tagged)
    counted = F.row_number().over(Window.partitionBy("group_key").orderBy("row_id"))
    return tagged.withColumn("revision", F.when(F.col("group_key").isNull(), F.lit(1)).otherwise(counted).cast("int"))


def ingest_stream(rows: DataFrame, personal_sources: str = K.PERSONAL_SOURCES) -> DataFrame:
    """The same over a stream of rows with the columns of a fact before tagging."""
    ship_package(rows.sparkSession)
    personal = frozenset(personal_sources.split())
    names = [c.split()[0] for c in TAGGED.split(", ")]

    def by_user(key, parts, state):
        last, tops = json.loads(state.get[0]) if state.exists else (None, {})
        done, last = tag(pd.concat(list(parts)).sort_values("row_id", kind="stable"), last, personal)
        revisions = []
        for project, entity in zip(done["project"], done["entity"], strict=True):
            if not isinstance(entity, str):
                revisions.append(1)
                continue
            group = json.dumps([project if isinstance(project, str) else None, entity])
            tops[group] = tops.get(group, 0) + 1
            revisions.append(tops[group])
        state.update((json.dumps([last, tops]),))
        yield done[names].assign(revision=pd.Series(revisions, index=done.index).astype("int32"))

    numbered = rows.select(*_IN).groupBy("user_id").applyInPandasWithState(by_user, TAGGED + ", revision int", "held string", "append", GroupStateTimeout.NoTimeout)
    return with_group_key(numbered)
