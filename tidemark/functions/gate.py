"""The write gate: is an utterance worth keeping? Surface features, four rules, a logistic head. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed as K
from tidemark.functions.text import strip

_WORD = r"\p{L}+"
_OTHER_LETTER = r"[\p{L}\p{N}\p{M}&&[^\x00-\x7F]]"
_any = lambda words: "^(?:" + "|".join(words.split()) + ")$"


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def _count_in(words: Column, listed: str) -> Column:
    names = [w for w in listed.split() if "'" not in w]  # words hold no apostrophes
    return F.size(F.filter(words, lambda w: w.isin(names)))


def prepared(text: Column, ascii_edges: bool = False) -> tuple[Column, Column, Column, Column]:
    """What all features share: the stripped text, the same in lower case, its words, and the text as patterns read it.

    To patterns a word is a run of any letters; with ``ascii_edges`` of ASCII ones, as in SQL engines: others end a word there.
    """
    t = strip(F.coalesce(text, F.lit("")))
    return t, F.lower(t), F.regexp_extract_all(F.lower(t), F.lit(_WORD), F.lit(0)), F.regexp_replace(t, _OTHER_LETTER, "§") if ascii_edges else t


_PARTS = ("__t", "__low", "__words", "__read")


def with_parts(rows: DataFrame, text: str = "text", ascii_edges: bool = False) -> tuple[DataFrame, tuple[Column, ...]]:
    """The rows with what :func:`prepared` gives as columns of their own, and these columns."""
    return rows.withColumns(dict(zip(_PARTS, prepared(F.col(text), ascii_edges), strict=True))), tuple(F.col(n) for n in _PARTS)


def features(text: Column, parts: tuple[Column, ...] | None = None) -> dict[str, Column]:
    """The 23 surface features by name; an empty text has zeros. ``parts``: the columns of :func:`prepared`, if they exist."""
    t, low, words, read = parts or prepared(text)
    n = F.greatest(F.size(words), F.lit(1))
    tokens = F.regexp_count(t, F.lit(r"(?U)\S+"))
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    say = lambda phrase: F.regexp_count(low, F.lit(phrase))
    solid = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    digits = F.regexp_count(t, F.lit(r"(?U)\d"))
    caps = F.regexp_count(t, F.lit(r"\b[A-Z][a-z]{1,}\b"))
    leading = F.regexp_count(t, F.lit(r"(?:^|[.!?]\s+|\n)\s*(?<!\w)[A-Z][a-z]{1,}\b"))
    has = lambda pattern: _flag(read.rlike(pattern))
    out = {
        "log_chars": F.log1p(F.length(t)) / 5,
        "log_tokens": F.log1p(tokens) / 5,
        "avg_token_len": solid / F.greatest(tokens, F.lit(1)) / 10,
        "has_question_mark": _flag(t.contains("?")),
        "ends_question": _flag(t.endswith("?")),
        "opens_interrogative": _flag(first.rlike(_any(K.OPEN_QUESTION))),
        "request_cue": _flag(first.rlike(_any(K.OPEN_REQUEST)) | low.contains("please")),
        "second_person_ratio": (_count_in(words, K.SECOND_WORDS) + say("you're") + say("youre")) / n,
        "first_person_ratio": (_count_in(words, K.FIRST_WORDS) + say("i'm") + say("i've") + say("i'll")) / n,
        "possessive_my_ratio": _count_in(words, "my our mine ours") / n,
        "self_predicate": has("(?i)" + K.SELF_PREDICATE),
        "digit_ratio": digits / F.greatest(F.length(t), F.lit(1)),
        "has_long_number": has(K.LONG_NUMBER),
        "has_email": has(K.GATE_EMAIL),
        "has_url_or_ip": _flag(read.rlike(K.GATE_URL) | read.rlike(K.IP)),
        "has_year_or_date": _flag(read.rlike(K.YEAR) | read.rlike(K.NUMERIC_DATE)),
        "has_clock_time": has("(?i)" + K.CLOCK),
        "has_month_or_weekday": _flag(F.arrays_overlap(words, F.array(*[F.lit(w) for w in K.CALENDAR.split()]))),
        "has_currency": has("(?i)" + K.CURRENCY),
        "has_measure_unit": has("(?i)" + K.UNIT),
        "proper_noun_ratio": (caps - leading) / n,
        "ack_opener": _flag(first.rlike(_any(K.OPEN_ACK))),
        "exclamation": _flag(t.contains("!")),
    }
    return {name: F.when(t == "", F.lit(0.0)).otherwise(value.cast("double")) for name, value in out.items()}


def rule(text: Column, parts: tuple[Column, ...] | None = None) -> Column:
    """The rule that decides before the head does, or null."""
    t, low, words, read = parts or prepared(text)
    has = lambda pattern: read.rlike("(?i)" + pattern)
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    short = (F.size(words).between(3, K.SHORT_FACT_WORDS)) & ~t.contains("?") & ~first.rlike(_any(K.OPEN_ACK)) & ~first.rlike(_any(K.OPEN_REQUEST)) & ~low.contains("please")
    return (
        F.when((F.length(t) < 3) | ~t.rlike(r"(?U)[\p{L}\p{N}]"), "empty_or_too_short")
        .when(has(K.FORGET), "explicit_forget_directive")
        .when(has(K.REMEMBER), "explicit_memory_directive")
        .when(short & ~has(K.NOT_A_FACT) & has(K.SHORT_FACT), "short_self_declarative_fact")
    )


def logit(values: dict[str, Column]) -> Column:
    """The head's margin: each feature held to the range it was fitted on, weighted and summed."""
    out = F.lit(K.GATE_BIAS)
    for name, weight, low, high in K.GATE:
        out = out + F.lit(weight) * F.least(F.greatest(values[name], F.lit(low)), F.lit(high))
    return out


def decide(rows: DataFrame, text: str = "text", threshold: float = K.GATE_THRESHOLD, ascii_edges: bool = False) -> DataFrame:
    """Adds ``reason``, ``prob`` and ``should_store``. ``ascii_edges`` as in :func:`prepared`."""
    # the shared parts and the features are columns of their own, so that each is worked out once a row
    rows, parts = with_parts(rows, text, ascii_edges)
    rows = rows.withColumn("__f", F.struct(*[c.alias(n) for n, c in features(F.col(text), parts).items()])).withColumn("__rule", rule(F.col(text), parts))
    rows = rows.withColumn("prob", 1 / (1 + F.exp(-logit({n: F.col(f"__f.{n}") for n, *_ in K.GATE}))))
    kept = F.col("__rule").isin("explicit_memory_directive", "short_self_declarative_fact")
    rows = rows.withColumn("should_store", F.when(F.col("__rule").isNull(), F.col("prob") >= threshold).otherwise(kept))
    return rows.withColumn("reason", F.coalesce("__rule", F.lit("learned_head"))).drop(*_PARTS, "__f", "__rule")
