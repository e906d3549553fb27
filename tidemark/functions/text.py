"""Text functions: fingerprints and ids, chunking and rejoining, line windows, question clauses, labels of time.

Column functions stay in the JVM; the chunker and its inverse are sequential folds over one text and
run in Python, in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed as K

_DENSE = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in K.DENSE_RANGES) + "]"
_DENSE_PY = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in K.DENSE_RANGES) + "]")


def strip(text: Column) -> Column:
    """Without white space at either end (Unicode)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def doc_fingerprint(text: Column) -> Column:
    return F.sha2(strip(text).cast("binary"), 256)


def doc_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(text.cast("binary")), 1, 10))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def dense_share(text: Column) -> Column:
    """Share of characters of scripts without word spaces among those that are not space; 0 of an empty text."""
    seen = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    dense = seen - F.length(F.regexp_replace(F.regexp_replace(text, r"(?U)\s", ""), _DENSE, ""))
    return F.when(seen > 0, dense / seen).otherwise(F.lit(0.0))


def is_dense(text: Column) -> Column:
    return dense_share(text) >= K.DENSE_SHARE


def normalize_entity_ascii(name: Column) -> Column:
    """The attribute-name form of ASCII text, without leaving the JVM."""
    out = F.lower(F.trim(name))
    for spelling, common in K.SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(common))
    return F.substring(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, K.MAX_NAME)


def structural_class(text: Column, skip: tuple[str, ...] = ()) -> Column:
    """The class that a text's shape or frame shows, of those not skipped; the phone class needs a run of digits and a cue."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, pattern in reversed([s for s in K.STRUCTURE if s[0] not in skip]):
        if name == "phone_number":
            runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            test = F.exists(runs, lambda r: F.length(F.regexp_replace(r, "[^0-9]", "")) >= K.PHONE_DIGITS) & (low.rlike(K.PHONE_CUE) | low.rlike(r"\bmy\b"))
        else:
            test = (text if name in K.CASED_SHAPES.split() else low).rlike(pattern)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def says(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, or one of the phrases anywhere."""
    low = F.lower(text)
    words = "|".join(c for c in cues if " " not in c)
    test = low.rlike(f"(?<![a-z])(?:{words})(?![a-z])")
    for phrase in (c for c in cues if " " in c):
        test = test | low.contains(phrase)
    return F.coalesce(test, F.lit(False))


def temporal_cue(text: Column) -> Column:
    return says(text, K.TIME_CUES)


def revision_marker(text: Column) -> Column:
    return says(text, K.CHANGE_MARKERS)


def pronoun_led(text: Column) -> Column:
    low = F.lower(strip(text))
    return low.rlike(K.PRONOUN_LED) & ~low.rlike(K.OWN)


def query_direction(text: Column) -> Column:
    low = F.lower(text)
    past = low.rlike(K.PAST_FRAME)
    back = low.rlike(K.ANTERIOR_STRONG) | (past & low.rlike(K.ANTERIOR_WEAK))
    first = low.rlike(K.INITIAL_STRONG) | (past & low.rlike(K.INITIAL_WEAK))
    return F.when(~F.coalesce(back, F.lit(False)), "current").when(low.rlike(K.IMMEDIATE), "previous").when(first, "oldest").otherwise("historical")


def line_windows(text: Column, lines: int = K.WINDOW_LINES, overlap: int = K.WINDOW_OVERLAP) -> Column:
    """``array<struct<start_line, end_line, text>>``: windows of ``lines`` lines, each ``overlap`` into the one before.

    A last empty line (the text ends with a line break) is no line. Windows without a word are left out.
    """
    rows = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    starts = F.sequence(F.lit(0), F.size(rows) - 1, F.lit(max(1, lines - overlap)))
    cut = F.transform(starts, lambda at: F.struct((at + 1).alias("start_line"), F.least(at + lines, F.size(rows)).alias("end_line"), F.array_join(F.slice(rows, at + 1, F.lit(lines)), "\n").alias("text")))
    return F.filter(cut, lambda w: w["text"].rlike(r"(?U)\S"))


def split_lines_by_words(lines: list[str], most: int = K.MAX_WORDS) -> list[list[str]]:
    """Runs of whole lines with at most ``most`` words each (a longer line stands alone)."""
    runs, words = [[]], 0
    for line in lines:
        n = len(line.split())
        if runs[-1] and words + n > most:
            runs.append([])
            words = 0
        runs[-1].append(line)
        words += n
    return runs


def dense(text: str) -> bool:
    found = 0 if text.isascii() else len(_DENSE_PY.findall(text))
    return found > 0 and found / sum(map(len, text.split())) >= K.DENSE_SHARE


def _pieces(text: str, most: int) -> list[str]:
    """Paragraphs; the long ones as sentences; sentences that are still too long cut hard."""
    def too_long(part: str) -> bool:
        return len(part) > K.MAX_DENSE_CHARS if dense(part) else len(part.split()) > most

    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    sentences = [s.strip() for p in parts for s in (re.split(r"(?<=[.!?。！？\n])\s+", p) if too_long(p) else [p]) if s.strip()]
    out = []
    for s in sentences:
        if not too_long(s):
            out.append(s)
        elif dense(s):
            out += [s[k : k + K.MAX_DENSE_CHARS] for k in range(0, len(s), K.MAX_DENSE_CHARS)]
        else:
            words = s.split()
            out += [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
    return out


def split_large_text(text, most: int = K.MAX_WORDS, overlap: int = K.OVERLAP_WORDS) -> list[str]:
    """Chunks of at most about ``most`` words, packed from whole paragraphs or sentences, bridged by an overlap."""
    whole = str(text or "").strip()
    if not whole:
        return []
    by_chars = dense(whole)
    limit = K.MAX_DENSE_CHARS if by_chars else most
    size = len if by_chars else (lambda s: len(s.split()))
    if size(whole) <= limit:
        return [whole]
    chunks, held, used = [], [], 0
    for piece in _pieces(whole, most):
        n = size(piece)
        if held and used + n > limit:
            chunks.append("\n\n".join(held))
            if by_chars:
                bridge = chunks[-1][-K.OVERLAP_DENSE_CHARS :] if len(chunks[-1]) > K.OVERLAP_DENSE_CHARS else ""
            else:
                words = " ".join(held).split()
                bridge = " ".join(words[-overlap:]) if len(words) > overlap else ""
            held, used = ([bridge], size(bridge)) if bridge else ([], 0)
        held.append(piece)
        used += n
    return [*chunks, "\n\n".join(held)] if held else chunks or [whole]


def join_chunks(chunks, most: int = K.JOIN_WORDS) -> str:
    """The words of all chunks, without what a chunk repeats from the end of the one before."""
    words: list[str] = []
    for chunk in chunks:
        new = str(chunk).split()
        width = next((k for k in range(min(most, len(words), len(new)), 0, -1) if words[-k:] == new[:k]), 0)
        words += new[width:]
    return " ".join(words)


def chunk_column(text: Column) -> Column:
    """:func:`split_large_text` over a column."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(split_large_text)

    return chunks(text)


def join_column(chunks: Column) -> Column:
    """:func:`join_chunks` over a column of arrays."""

    @F.pandas_udf("string")
    def join(lists: pd.Series) -> pd.Series:
        return lists.map(lambda c: "" if c is None else join_chunks(c))

    return join(chunks)


def decompose_query(text) -> list[str]:
    """The questions within a question; the question itself if there is but one."""
    whole = str(text or "").strip()
    clauses = [c.strip(" \t\n\r,.;:-?") for part in re.split(r"[?;]+", whole) for c in re.split(K.CLAUSE_SPLIT, part, flags=re.IGNORECASE)]
    clauses = [c for c in clauses if len(c.split()) >= 2]
    if len(clauses) > 1:
        return clauses
    m = re.match(K.LIST_QUESTION, whole, re.IGNORECASE)
    if m:
        items = [i.strip() for i in re.split(r",\s*(?:and\s+)?|\s+and\s+", m[2].strip(" ?."), flags=re.IGNORECASE)]
        items = [i for i in items if i]
        if len(items) > 1:
            return [f"{m[1].strip()} {i}" for i in items]
    return [whole] if whole else []


def staleness_label(superseded: Column, superseded_at: Column, now: Column) -> Column:
    """What to say beside a value that was replaced, and how long ago; empty where nothing replaced it."""
    days = F.greatest(now - superseded_at, F.lit(0.0)) / F.lit(86400.0)
    ago = (
        F.when(days < 1, F.lit("today"))
        .when(days < 45, F.concat(F.round(days).cast("int").cast("string"), F.lit(" days ago")))
        .when(days < 730, F.concat(F.round(days / 30.44).cast("int").cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(F.round(days / 365.25, 1).cast("decimal(10,1)").cast("string"), F.lit(" years ago")))
    )
    said = F.concat(F.lit("SUPERSEDED - replaced "), ago, F.lit("; this was true when written, not now"))
    return F.when(~F.coalesce(superseded, F.lit(False)), F.lit("")).otherwise(F.coalesce(said, F.lit("SUPERSEDED - a later record replaced this value")))


def parse_time(text: Column) -> Column:
    """Epoch seconds of a number, an ISO instant, or a date (its midnight in the session's zone)."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6))


def format_time(ts: Column) -> Column:
    return F.date_format(F.timestamp_micros((ts * 1e6).cast("long")), "yyyy-MM-dd HH:mm")


def format_span(seconds: Column) -> Column:
    """A length of time in a unit that a reader can act on."""
    s = F.greatest(seconds, F.lit(0.0))
    out = F.concat(F.format_string("%.1f", s / (365.25 * 86400)), F.lit("y"))
    for unit, size, most in (("mo", 30.44 * 86400, 730 * 86400), ("d", 86400, 90 * 86400), ("h", 3600, 48 * 3600), ("min", 60, 90 * 60), ("s", 1, 90)):
        out = F.when(s < most, F.concat(F.format_string("%.0f", s / float(size)), F.lit(unit))).otherwise(out)
    return F.when(seconds.isNull(), F.lit("n/a")).otherwise(out)
