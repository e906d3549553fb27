"""Metadata predicates: the coercing filter, the strict one, and guards for destructive criteria."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that the engine writes itself and callers may not set (fixed values).
RESERVED = ("id", "parent_id", "chunk_index", "chunk_total", "is_chunked", "parent_sha256", "embed_backend")


def _spoken(value) -> str:
    """A value's text as the reference spells it: True, 1.0, None."""
    return str(value)


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def _stored(raw: Column, kind: Column) -> Column:
    """The text form of a stored JSON scalar, by its kind."""
    plain = raw.cast("string")
    number = raw.try_cast("double")
    whole = F.when(plain.rlike(r"^-?\d+$"), plain).when(F.abs(number) < 1e16, F.when(number == F.floor(number), F.concat(number.cast("bigint").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))).otherwise(number.cast("string"))
    return F.when(kind == "true", "True").when(kind == "false", "False").when(kind == "null", "None").when(kind == "number", whole).otherwise(plain)


def _entry(metadata: Column, key: str) -> tuple[Column, Column]:
    """The variant under a key and its type name; null where the key is missing."""
    value = F.try_variant_get(F.try_parse_json(metadata), "$['" + key + "']", "variant")
    return value, F.schema_of_variant(value)


def matches(metadata: Column, where: dict) -> Column:
    """AND over keys; a key must exist.

    A scalar wanted equals the stored value or its text form, or is an element of a stored list. A list
    wanted holds the stored scalar (or its text form); a stored list then matches only as an element.
    """
    out = F.lit(True)
    for key, wanted in where.items():
        value, kind = _entry(metadata, key)
        raw = value.cast("string")
        of = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", raw).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), "number").otherwise("string")
        spoken = _stored(raw, of)
        listed = kind.startswith("ARRAY")
        if isinstance(wanted, (list, tuple, set)):
            nested = [json.dumps(w, separators=(",", ":")) for w in wanted if isinstance(w, (list, tuple))]
            test = F.when(listed, F.to_json(value).isin(nested) if nested else F.lit(False)).otherwise(spoken.isin([_spoken(w) for w in wanted]))
        else:
            inside = F.exists(F.try_variant_get(value, "$", "array<string>"), lambda x: x == F.lit(_spoken(wanted) if not isinstance(wanted, bool) else str(wanted).lower()))
            test = F.when(listed, inside).otherwise(spoken == _spoken(wanted))
        out = out & F.coalesce(value.isNotNull() & test, F.lit(False))
    return out


def matches_strictly(metadata: Column, where: dict) -> Column:
    """Equality of value and kind under every key."""
    out = F.lit(True)
    for key, wanted in where.items():
        value, _ = _entry(metadata, key)
        out = out & F.coalesce(F.to_json(value) == F.lit(json.dumps(wanted, separators=(",", ":"))), F.lit(False))
    return out


def check_criterion(name: str, value) -> None:
    """A blank text or an empty mapping on a destructive criterion would match everything: refuse it. None means absent."""
    if (isinstance(value, str) and not value.strip()) or (isinstance(value, dict) and not value):
        raise ValueError(f"{name} is empty: leave it out, or name what to match")


def check_reserved(metadata: dict) -> None:
    taken = sorted(set(metadata) & set(RESERVED))
    if taken:
        raise ValueError(f"reserved metadata keys: {', '.join(taken)}")
