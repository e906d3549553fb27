"""Near-duplicate line removal by a deletion-neighbourhood join.

A line is its words, A-Z lower-cased; lines without a word are left alone. Two lines are near if one edit
of a word (replaced, added or taken out) makes them equal; for lines of fewer than ``near_words``
words, of which one word is too large a part, the bound is no edit. Of lines that are equal or near, the earliest by
``(doc_id, line)`` stays: a line goes if an earlier line equals it or is within the bound of it.

Equal lines collapse first, so everything after works on distinct lines. Each distinct line then
emits its deletion neighbourhood as hashed keys, and equal keys meet in a shuffle:

* ``S``: the line without word i, with i and its length. Lines that meet differ in word i only.
* ``D``: the whole line, and every longer line without one word. They differ by one added word.

Lines of an S key are all near each other, so each is compared with the least of them; a D key holds
one whole line (equal lines have collapsed), which is compared with the least of the longer ones and
each of those with it. No pairs are emitted within a key.
Every line that met an earlier one is then verified against its text by word edit distance.

The bound grows with a line: one word edit below ``2 * EDIT_WORDS`` words, then one for every ``EDIT_WORDS``.
Deleting each choice of several words would give very many variants, so the neighbourhood of a long
line is emitted by its parts: a line of N words with N / 48 edits keeps a run of 32 words at least
without an edit. Winnowing (of every 26 neighbouring 7-word runs the one with the least hash) picks
places by content alone, and any 32 words hold a whole choice, so two such lines share a part; of very
long lines about ``LONG_KEYS`` parts are kept, again by hash. Lines that share a part and agree in length to a few
per cent are verified by word edit distance; of long lines that are linked, directly or through others,
the earliest stays. Within a part all are compared with a few members and only what that leaves
unconnected in blocks (:mod:`tidemark.llm.shingles`).

Emitting a variant per word for a whole corpus would cost as many rows as it has words. A lossless
test spares lines that cannot have a partner: of two lines one word edit apart, either the first half
or the rest is untouched, so lines whose halves (3 keys a line) no other line shares emit nothing.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shingles
from tidemark.llm.common import arrow_type, materialize
from tidemark.runtime import ship_package

MIN_WORDS = 1
NEAR_WORDS = 8
#: Words of a line for each edit, and the runs and windows that choose a long line's parts.
EDIT_WORDS = 48
RUN, CHOICE = 7, 26
LONG_KEYS = 64
_LAST = (1 << 63) - 1
_LAST_TEXT = chr(0x10FFFF)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_digest = xxhash.xxh64_intdigest


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def half_keys(words: list[bytes]) -> list[int]:
    """Keys (unsigned) of which two lines one word edit apart share at least one.

    For a pair whose longer line has N words, an edit in its first N//2 words leaves the last
    N - N//2 words of both alone, and one after them leaves the first N//2. A line of n words is the
    longer line for N = n and the shorter for N = n + 1; for one of the two N its first words are as
    many as for the other, and so are its last words for the other, so three keys do.
    """
    n = len(words)
    half = n // 2
    head, tail = b" ".join(words[:half]), b" ".join(words[half:])
    if n % 2:
        return [_digest(head, 2), _digest(head + b" " + words[half], 2), _digest(tail, 3)]
    return [_digest(head, 2), _digest(tail, 3), _digest(words[half - 1] + b" " + tail, 3)]


def variants(words: list[bytes]) -> np.ndarray:
    """Hashed keys of the deletion neighbourhood: that of the whole line, then the D key of each word, then the S keys."""
    n = len(words)
    norm = b" ".join(words)
    out = [_digest(norm, 1)]
    at = 0
    for k, w in enumerate(words):
        end = at + len(w)
        out.append(_digest(norm[: at - 1] + norm[end:] if k else norm[end + 1 :], 1))
        at = end + 1
    keys = np.array(out, np.uint64)
    # an S key is the D key and the word's place among how many, mixed one to one
    placed = (keys[1:] ^ ((np.uint64(n) << np.uint64(32)) + np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(_BASE)) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([keys, placed ^ (placed >> np.uint64(32))]).view(np.int64)


def bound(words: int) -> int:
    """The edits within which a line of so many words is near a shorter one or an equally long one."""
    return max(1, words // EDIT_WORDS)


#: Lines from here on may be near to one with a bound of two edits.
LONG = 2 * EDIT_WORDS - 2


def within(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether the word edit distance is at most ``most``: furthest reach along each diagonal, edit by edit."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    none = -(n + m) - 2
    reach: dict[int, int] = {}
    for edits in range(most + 1):
        now = {}
        for d in range(-edits, edits + 1):
            at = max(reach.get(d - 1, none), reach.get(d, none) + 1, reach.get(d + 1, none) + 1) if edits else 0
            at = min(at, n, m - d)
            if at < max(0, -d):
                continue
            while at < n and at + d < m and a[at] == b[at + d]:
                at += 1
            if d == m - n and at == n:
                return True
            now[d] = at
        reach = now
    return False


def near(a: list[bytes], b: list[bytes]) -> bool:
    return within(a, b, bound(max(len(a), len(b))))


_CHUNK = 1 << 20  # bytes of lines that are hashed at once


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


@functools.cache
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, _CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


def long_parts(lines: list[bytes]) -> list[np.ndarray]:
    """Parts of normalised lines of at least ``LONG`` words each, of which two near lines share at least one."""
    out, at = [], 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) < _CHUNK):
            size += len(lines[to]) + 1
            to += 1
        out += _parts_of(lines[at:to])
        at = to
    return out


def _parts_of(lines: list[bytes]) -> list[np.ndarray]:
    flat = b" ".join(lines)
    codes = np.frombuffer(flat, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(flat)]])
    sizes = np.array([x.count(b" ") + 1 for x in lines])
    # the hash of a stretch of bytes from prefix sums of a polynomial, moved to power zero
    size = len(flat)
    up, back = _chunk_powers() if size <= _CHUNK else (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(np.multiply(codes, up[:size], dtype=np.uint64), out=sums[1:])
    n = len(starts) - RUN + 1
    runs = (sums[ends[RUN - 1 :]] - sums[starts[:n]]) * back[starts[:n]]
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(32)
    # the least of CHOICE neighbours, by doubling
    least, wide = runs, 1
    while 2 * wide <= CHOICE:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(least) - (CHOICE - wide)], least[CHOICE - wide :])
    last = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lines)), sizes)[: len(least)]
    whole = np.arange(len(least)) + RUN + CHOICE - 1 <= last[owner]
    limit = np.minimum(1.0, LONG_KEYS * (CHOICE + 1) / (2.0 * sizes))
    whole &= least <= (limit * float((1 << 64) - 2048)).astype(np.uint64)[owner]
    owner, least = owner[whole], least[whole]
    fresh = np.ones(len(least), bool)  # neighbours mostly choose the same run
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    owner, least = owner[fresh], least[fresh]
    return [np.unique(x).view(np.int64) for x in np.split(least, np.searchsorted(owner, np.arange(1, len(lines))))]


def word_tokens(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the words, each occurrence of a word as a value of its own."""
    seen: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        n = seen[w] = seen.get(w, -1) + 1
        out[k] = xxhash.xxh64_intdigest(w, n)
    return np.sort(out)


def _norm(line: bytes) -> list[bytes]:
    return line.lower().split()


_NONE = np.empty(0, np.int64)


def signatures(rows: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """``(row_key, ord, line, h, halves, parts, n_words)`` of every line with at least ``min_words`` words; ``parts`` are those of a long line."""
    kind, ord_type = dict(rows.dtypes)["ord"], arrow_type(rows, "ord")

    def run(batches):
        for batch in batches:
            keys, ords, lines, hashes, halves, sizes, counts, long = [], [], [], [], [], [0], [], []
            for key, ordinal, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                for at, line in enumerate(text.lower().split(b"\n")):
                    words = line.split()
                    if len(words) >= min_words:
                        keys.append(key)
                        ords.append(ordinal)
                        lines.append(at)
                        norm = b" ".join(words)
                        hashes.append(_digest(norm))
                        if near_words <= len(words) < 2 * EDIT_WORDS:
                            halves += half_keys(words)
                        sizes.append(len(halves))
                        counts.append(len(words))
                        if len(words) >= LONG:
                            long.append(norm)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), _signed(halves))
            columns = [pa.array(keys, pa.int64()), pa.array(ords, ord_type), pa.array(lines, pa.int32()), _signed(hashes), lists]
            found = iter(long_parts(long))
            columns += [pa.array([next(found) if n >= LONG else _NONE for n in counts], pa.list_(pa.int64())), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "ord", "line", "h", "halves", "parts", "n_words"])

    return rows.mapInArrow(run, f"row_key long, ord {kind}, line int, h long, halves array<long>, parts array<long>, n_words int")


def _candidate_texts(rows: DataFrame) -> DataFrame:
    """``(h, ord, row_key, line, norm, n_words)`` of the wanted lines of rows ``(row_key, ord, text, wanted)``."""
    kinds = (pa.int64(), arrow_type(rows, "ord"), pa.int64(), pa.int32(), pa.binary(), pa.int32())

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for key, ordinal, text, wanted in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                lines = text.split(b"\n")
                for at in sorted(set(wanted)):
                    words = _norm(lines[at])
                    norm = b" ".join(words)
                    for col, value in zip(cols, (_digest(norm), ordinal, key, at, norm, len(words)), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([_signed(cols[0]), *[pa.array(c, t) for c, t in zip(cols[1:], kinds[1:], strict=True)]], ["h", "ord", "row_key", "line", "norm", "n_words"])

    return rows.mapInArrow(run, f"h long, ord {dict(rows.dtypes)['ord']}, row_key long, line int, norm binary, n_words int")


def _neighbourhoods(lines: DataFrame) -> DataFrame:
    """``(key, whole, h)``: the hashed variants of each line, ``whole`` where the key is of the line itself."""

    def run(batches):
        for batch in batches:
            heads, keys, whole = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for k, norm in enumerate(batch.column(1).to_pylist()):
                found = variants(norm.split(b" "))
                keys.append(found)
                heads.append(np.full(len(found), k))
                whole.append(np.arange(len(found)) == 0)
            at = pa.array(np.concatenate(heads))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(whole)), batch.column(0).take(at)], ["key", "whole", "h"])

    return lines.select("h", "norm").mapInArrow(run, "key long, whole boolean, h long")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``(row_key, ord, line, reason)`` of every line that goes; reason ``exact`` or ``near``."""
    if near_words < 2 or min_words < 1:
        raise ValueError("near_words must be 2 or more and min_words 1 or more")
    rows = _keyed(docs).select("row_key", "ord", F.col("text").cast("binary").alias("text")).where("text is not null")
    sigs = materialize(signatures(rows, min_words, near_words), "signatures")
    place = F.struct("ord", "row_key", "line")
    classes = materialize(sigs.groupBy("h").agg(F.min(place).alias("first"), F.min_by("halves", place).alias("halves"), F.min_by("parts", place).alias("parts"), F.first("n_words").alias("n_words"), F.count("*").alias("n")), "classes", drop_shuffles=True)
    # a half is shared if two different lines have it; bare hashes are all that is shuffled here, and once
    halves = _several(classes.where(F.size("halves") > 0).select("h", F.explode("halves").alias("key")))
    met = materialize(_long_meetings(classes), "met_long", drop_shuffles=True)
    wanted = halves.select("h").union(met.select("sig")).distinct()
    by_row = classes.select("h", "first").join(wanted, "h", "left_semi").groupBy(F.col("first.row_key").alias("row_key")).agg(F.collect_list("first.line").alias("wanted"))
    lines = materialize(_candidate_texts(rows.join(by_row, "row_key").select("row_key", "ord", "text", "wanted")).dropDuplicates(["h", "ord", "row_key", "line"]), "lines", drop_shuffles=True)
    # so too for the variants: the few keys that two lines share are found first, then who has them
    cloud = _several(_neighbourhoods(lines.where(F.col("n_words") < 2 * EDIT_WORDS)))
    cloud = materialize(cloud.join(lines.select("h", place.alias("place")), "h"), "met", drop_shuffles=True)
    one = F.struct("place", "h")
    keys = cloud.groupBy("key").agg(F.min(F.when(F.col("whole"), one)).alias("line_itself"), F.min(F.when(~F.col("whole"), one)).alias("least"))
    partner = F.when(~F.col("whole") & F.col("line_itself").isNotNull(), F.col("line_itself")).otherwise(F.col("least"))
    short = cloud.join(keys, "key").select("h", "place", partner.alias("partner"))
    short = short.where(F.col("partner.place") < F.col("place")).select("h", F.col("partner.h").alias("other")).distinct()
    late = materialize(_verified(short, lines).select("h").union(_late_long(met, lines, place)).distinct().withColumn("near", F.lit(True)), "near", drop_shuffles=True)
    # most lines are the only one of their class and near no earlier one: none of these can go
    marked = classes.select("h", "first", "n").join(late, "h", "left").where("n > 1 or near").select("h", "first", "near")
    flagged = sigs.select("row_key", "ord", "line", "h").join(marked.hint("shuffle_hash"), "h")
    first = F.struct("ord", "row_key", "line") == F.col("first")
    reason = F.when(~first, F.lit("exact")).when(F.col("near"), F.lit("near"))
    return flagged.select("row_key", "ord", "line", reason.alias("reason")).where("reason is not null")


def _several(rows: DataFrame) -> DataFrame:
    """The rows ``(key, h, ...)`` whose key two different lines have.

    Counts and rows read one and the same shuffle, so rows are made and dealt out once; memory holds the few shared keys
    of a partition. For Spark to see that the shuffles are one, both sides ask for all columns and no null key or hash
    (there are none), whatever is asked of the result.
    """
    more = [c for c in rows.columns if c not in ("key", "h")]
    dealt = rows.where("key is not null and h is not null").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("top"), *[F.max(c).alias(f"most_{c}") for c in more])
    shared = shared.where(" and ".join(["low <> top", *[f"most_{c} is not null" for c in more]])).select("key")
    return dealt.join(shared.hint("shuffle_hash"), "key").select(rows.columns)  # a semi-join would go below its shuffle


def _verified(met: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs ``(h, other)`` whose lines are near each other."""
    sizes = lines.select("h", "n_words")
    sized = met.join(sizes, "h").join(sizes.select(F.col("h").alias("other"), F.col("n_words").alias("other_words")), "other")
    allowed = F.greatest(F.lit(1), F.floor(F.greatest("n_words", "other_words") / EDIT_WORDS))
    # texts are fetched only for pairs whose lengths are within the bound
    close = sized.where(F.abs(F.col("n_words") - F.col("other_words")) <= allowed).select("h", "other")
    texts = lines.select("h", "norm")
    pairs = close.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("norm").alias("other_norm")), "other").select("h", "other", "norm", "other_norm")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([near(x.split(b" "), y.split(b" ")) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["h", "other"]).filter(keep)

    return pairs.mapInArrow(run, "h long, other long")


def _long_meetings(classes: DataFrame) -> DataFrame:
    """``(key, sig, pivots)`` of the long lines that share a part and are of about one length."""
    parts = classes.where(F.size("parts") > 0).select("h", "n_words", F.explode("parts").alias("key"))
    some = _several(parts).select(F.col("h").alias("sig"), "n_words", F.col("key").alias("part"))
    # near lines differ by at most 2 in 96 words, so of two neighbouring steps of 2.5 % they share one
    step = F.floor(F.log(F.col("n_words").cast("double")) / math.log(1.025))
    return shingles.meetings(some.select("sig", "part", F.explode(F.array(step, step + 1)).alias("step")).select("sig", F.xxhash64("part", "step").alias("key")))


def _late_long(met: DataFrame, lines: DataFrame, place) -> DataFrame:
    """``(h)`` of the long lines that are linked to an earlier one."""
    keys = met.groupBy(F.col("sig").alias("h")).agg(F.collect_set("key").alias("keys"))  # at most about 2 * LONG_KEYS
    long = lines.join(keys, "h")

    def run(batches):
        for batch in batches:
            found = pa.array([word_tokens(x.split(b" ")).tobytes() for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], ["sig", "norm", "keys", "found"])

    sets = materialize(long.select("h", "norm", "keys").mapInArrow(run, "sig long, norm binary, keys array<long>, found binary"), "long", drop_shuffles=True)

    def pivoted(pairs: DataFrame) -> DataFrame:
        return _verified(pairs.select(F.col("a").alias("h"), F.col("b").alias("other")), lines).select(F.col("h").alias("a"), F.col("other").alias("b"))

    def enough(size, sizes, both):  # an edit spoils one word of the longer line at most
        most = np.maximum(size, sizes)
        return both >= most - np.maximum(1, most // EDIT_WORDS)

    roots = shingles.linked(met, sets, pivoted, enough, lambda a, b: near(a.split(b" "), b.split(b" ")))
    placed = roots.join(long.select(F.col("h").alias("node"), place.alias("place")), "node")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    return placed.join(first, "root").where(F.col("place") > F.col("first")).select(F.col("node").alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, a hash of id and text, and ``ord``, the id's place (null: last): a number, or a text in code point order."""
    text_ids = dict(docs.dtypes)["doc_id"] == "string"
    place = F.coalesce("doc_id", F.lit(_LAST_TEXT)) if text_ids else F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("ord", place)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The columns of ``docs`` with repeated and near-repeated lines gone from ``text``, and three counts.

    Adds ``n_lines``, ``n_exact`` and ``n_near`` (lines removed as equal, as near). Row order of ids
    decides which line is earliest; null ids come last; ties (equal ids) go by a hash of the row. Rows
    equal in id and text count as one document and are all treated alike. Null and empty texts come
    back as they are. Other columns are kept; a column named like an added one is replaced. An empty
    table gives no rows.
    """
    ship_package(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    gone = removals(docs, min_words, near_words).select("row_key", "line", (F.col("reason") == "near").alias("near")).distinct()
    gone = gone.groupBy("row_key").agg(F.collect_list("line").alias("gone"), F.sum(F.col("near").cast("int")).cast("int").alias("near"))
    held = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), F.col("text").cast("binary").alias("text"))
    joined = held.join(gone, "row_key", "left").select("rest", "text", "gone", "near")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_gone = [], [], []
            for text, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = [] if text is None else text.split(b"\n")
                n_lines.append(len(lines))
                n_gone.append(len(out or ()))
                if out:
                    out = set(out)
                    text = b"\n".join([x for k, x in enumerate(lines) if k not in out])
                texts.append(text)
            near = np.array([k or 0 for k in batch.column(3).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int32()), pa.array(np.array(n_gone, np.int32) - near), pa.array(near)], ["rest", "text", "n_lines", "n_exact", "n_near"])

    schema = T.StructType([joined.schema["rest"], T.StructField("text", T.BinaryType()), *[T.StructField(c, T.IntegerType()) for c in ("n_lines", "n_exact", "n_near")]])
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names], "n_lines", "n_exact", "n_near")
