"""Near-duplicates by SimHash balls and by the Jaccard similarity of word shingles (banded MinHash, exact verification).

Two relations link documents, and classes follow both: fingerprints at most two bits apart, by the ball
hashing of ``simhash``, and sets of shingles at a similarity of 0.8 or more. Neither holds the other: most
pairs at 0.8 differ in more bits than a ball can hold, and long texts with scattered edits fall below 0.8
of five-word shingles while their fingerprints hardly change.

A document is the set of its 5-word shingles (A-Z lower-cased; a shorter text is one shingle). Equal sets
collapse first. Each distinct set then emits ``BANDS`` keys, each of ``ROWS`` minima of hashed shingles;
sets of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS, which at 0.8 leaves out
1.3e-7 of the pairs and above it fewer. Every pair that meets is verified on the whole sets.

Within a key all are first compared with ``PIVOTS`` members chosen by hash, other ones in every key. In
keys whose members that leaves unconnected, the members outside the commonest component are compared
with all others, in blocks: no pair of similar sets that share a key is left out, no pair is emitted
before it is verified, and a large group of near copies is mostly connected by its pivots.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import components, materialize, text_bytes

SEED = 42
BANDS, ROWS = 40, 5
#: Members that all others of a key are compared with first, and the sizes of blocks of the comparison that follows.
PIVOTS = 6
LATE_BLOCK, ALL_BLOCK = 128, 2048
_CHUNK = 1 << 12
#: Columns and cells of the matrices that count shared values.
_COLUMNS, _CELLS = 1 << 12, 1 << 21
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, (1 << 64) - 1, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles; none if it has no words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    norm = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(norm)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(norm[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """``BANDS`` hashed keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, (_MULTIPLY[:, None] * found[None, at : at + _CHUNK] + _ADD[:, None]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of ``least`` or more."""
    low, high = sorted((len(a), len(b)))
    if low < least * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (low + high - both)


def _signatures(rows: DataFrame, size: int, fp_size: int) -> DataFrame:
    """``(row_key, doc_id, sig, fp, keys)``: a hash of each row's set, the text's fingerprint and the keys of the set's bands."""

    def run(batches):
        for batch in batches:
            sigs, fps, keys = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, size)
                fps.append(simhash.fingerprint(text, fp_size))
                sigs.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(band_keys(found))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sigs, fps)], lists], ["row_key", "doc_id", "sig", "fp", "keys"])

    return rows.mapInArrow(run, f"row_key long, doc_id {dict(rows.dtypes)['doc_id']}, sig long, fp long, keys array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """``(sig, found, keys)`` of rows ``(sig, text)``: the shingles and the keys as bytes."""

    def run(batches):
        for batch in batches:
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([band_keys(f).tobytes() for f in found], pa.binary())], ["sig", "found", "keys"])

    return rows.mapInArrow(run, "sig long, found binary, keys binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(xs, ys, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def meetings(keys: DataFrame) -> DataFrame:
    """``(key, sig, pivots, others)`` of the keys that several sets share: ``PIVOTS`` members chosen by hash, and how many more there are.

    ``keys(sig, key)`` lists a key of a set once. Few keys are shared: they are found by bare counts
    first, and only their members take part in the choice of pivots. A pivot is the least member after an
    exclusive or with a hash of the key, which can be undone, so the choice is a minimum of plain numbers.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(keys.join(shared, "key", "left_semi").select("key", "sig"), "shared", drop_shuffles=True)
    mask = lambda turn: F.xxhash64(F.lit(turn), "key")
    chosen = met.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.col("sig").bitwiseXOR(mask(turn))).alias(f"p{turn}") for turn in range(PIVOTS)])
    pivots = F.array_distinct(F.array(*[F.col(f"p{turn}").bitwiseXOR(mask(turn)) for turn in range(PIVOTS)]))
    chosen = chosen.select("key", "n", pivots.alias("pivots"))
    return met.join(chosen, "key").select("key", "sig", "pivots", (F.col("n") - F.size("pivots")).alias("others"))


def stragglers(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``(key, sig, root, late, n_late, n_all)`` of keys whose members are not all connected nor all compared.

    ``late`` marks the members outside the key's commonest root. Every pair that is not connected has
    one of them on a side. All members have been compared with the pivots, so keys with fewer than two
    other members are done.
    """
    rooted = met.where("others > 1").select("key", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("root", "sig").alias("root"))
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    of_key = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n_all"), F.count("*").alias("n_roots")).where("n_roots > 1")
    of_key = of_key.select("key", F.col("main.root").alias("main"), (F.col("n_all") - F.col("main.n")).alias("n_late"), "n_all")
    return rooted.join(of_key, "key").select("key", "sig", "root", (F.col("root") != F.col("main")).alias("late"), "n_late", "n_all")


def shared_values(asked: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``others`` shares with each of ``asked``, all arrays of distinct values: a row for each of ``others``.

    A product of incidence matrices over the values on both sides, ``_COLUMNS`` values and ``_CELLS`` cells at a time.
    """
    out = np.zeros((len(others), len(asked)), np.int64)
    if not out.size:
        return out
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    values, askers = flat(asked)
    columns, values = np.unique(values, return_inverse=True)
    if not len(columns):
        return out
    height = max(1, _CELLS // _COLUMNS)
    for top in range(0, len(others), height):
        held, owners = flat(others[top : top + height])
        place = np.minimum(np.searchsorted(columns, held), len(columns) - 1)
        there = columns[place] == held
        place, owners = place[there], owners[there]
        used, place = np.unique(place, return_inverse=True)  # most values are on one side only
        where = np.full(len(columns), -1)
        where[used] = np.arange(len(used))
        spots = where[values]
        rows = min(height, len(others) - top)
        for left in range(0, len(used), _COLUMNS):
            width = min(_COLUMNS, len(used) - left)
            a, b = np.zeros((len(asked), width), np.float32), np.zeros((rows, width), np.float32)
            some = (spots >= left) & (spots < left + width)
            a[askers[some], spots[some] - left] = 1
            some = (place >= left) & (place < left + width)
            b[owners[some], place[some] - left] = 1
            out[top : top + rows] += (b @ a.T).astype(np.int64)
    return out


def compared(open_: DataFrame, sets: DataFrame, similar_sizes, verified=None) -> DataFrame:
    """The similar pairs ``(a, b)`` of unconnected members of a key, by blocks of late members against blocks of all.

    ``sets`` has ``(sig, found, keys)``, keys as an array or as bytes, and a column ``norm`` if ``verified`` is given. A pair passes where
    ``similar_sizes(size, sizes, shared)`` holds for its numbers of values, and ``verified(norm, norm)`` then.
    No pair is emitted before that: a block holds at most about ``LATE_BLOCK`` late members and
    ``ALL_BLOCK`` others, whatever the key's size. A pair that shares several keys is compared in the
    least of them only.
    """
    late_blocks = F.ceil(F.col("n_late") / LATE_BLOCK).cast("int")
    all_blocks = F.ceil(F.col("n_all") / ALL_BLOCK).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "sig"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    as_late = open_.where("late").withColumn("late_block", own(late_blocks, 1)).withColumn("all_block", every(all_blocks)).withColumn("asks", F.lit(True))
    as_one = open_.withColumn("all_block", own(all_blocks, 2)).withColumn("late_block", every(late_blocks)).withColumn("asks", F.lit(False))
    rows = as_late.unionByName(as_one).select("key", "late_block", "all_block", "sig", "root", "late", "asks").join(sets, "sig")

    def run(block: pa.Table) -> pa.Table:
        key = block.column("key")[0].as_py()
        asks, late = (np.array(block.column(c).to_pylist(), bool) for c in ("asks", "late"))
        sig, root = (block.column(c).to_numpy() for c in ("sig", "root"))
        found = [np.frombuffer(x, np.uint64) for x in block.column("found").to_pylist()]
        keys = [np.frombuffer(x, np.int64) if isinstance(x, bytes) else np.array(x, np.int64) for x in block.column("keys").to_pylist()]
        norms = block.column("norm").to_pylist() if verified else None
        out: list[tuple[int, int]] = []
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        # in the least of the keys that a pair shares: none below this one is on both sides
        lower = [x[x < key] for x in keys]
        open_pairs = (root[right][:, None] != root[left]) & (shared_values([lower[k] for k in left], [lower[k] for k in right]) == 0)
        # both late: seen from either side, kept from one
        open_pairs &= ~(late[right][:, None] & (sig[left] > sig[right][:, None]))
        sizes = np.array([len(x) for x in found], np.int64)
        # as many shared values as can be: sizes alone leave out many
        open_pairs &= similar_sizes(sizes[right][:, None], sizes[left], np.minimum(sizes[right][:, None], sizes[left]))
        left, right, open_pairs = left[open_pairs.any(axis=0)], right[open_pairs.any(axis=1)], open_pairs[open_pairs.any(axis=1)][:, open_pairs.any(axis=0)]
        both = shared_values([found[k] for k in left], [found[k] for k in right])
        open_pairs &= similar_sizes(sizes[right][:, None], sizes[left], both)
        for i, j in np.argwhere(open_pairs).tolist():
            k, a = int(right[i]), int(left[j])
            if verified is None or verified(norms[a], norms[k]):
                out.append((int(sig[a]), int(sig[k])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "late_block", "all_block").applyInArrow(run, "a long, b long")


def linked(met: DataFrame, sets: DataFrame, pivoted, similar_sizes, verified=None) -> DataFrame:
    """``(node, root)`` of members of shared keys that are linked, directly or through others.

    ``pivoted(pairs)`` gives those of the pairs ``(a, b)`` of members and pivots that are similar; members
    that these leave unconnected are :func:`compared`.
    """
    offered = met.select("sig", F.explode("pivots").alias("pivot")).where("pivot <> sig")
    offered = offered.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()
    first = materialize(pivoted(offered), "first", drop_shuffles=True)
    roots = materialize(components(first), "roots")
    open_ = materialize(stragglers(met, roots), "open", drop_shuffles=True)
    if open_.isEmpty():
        return roots
    second = materialize(compared(open_, sets, similar_sizes, verified), "second", drop_shuffles=True)
    return roots if second.isEmpty() else components(first.union(second))


def met_in_balls(classes: DataFrame, sigs: DataFrame) -> DataFrame:
    """``(node, root)`` of the roots of ``classes`` that fingerprints of ``sigs`` join.

    A ball that several roots meet in links each of them with the least.
    """
    held = sigs.select("sig", "fp").distinct().join(classes.select("sig", "root"), "sig").join(simhash.balls(sigs), "fp").select("ball", "root").distinct()
    held = materialize(held, "held")
    several = held.groupBy("ball").agg(F.min("root").alias("least"), F.count("*").alias("n")).where("n > 1")
    return components(held.join(several, "ball").select(F.col("root").alias("a"), F.col("least").alias("b")))


def near_duplicates(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5), fp_size: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, component_id``.

    Rows link where the SimHashes of their ``fp_size``-word shingles differ in at most 2 bits, or where
    their sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more (texts without
    words: with each other); ``component_id`` is the least ``doc_id`` reachable (null only if no row
    reachable has an id). Bands are chosen for 0.8; a lower ``least`` finds fewer of its pairs.
    """
    keyed = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = text_bytes(keyed, "row_key", "doc_id")
    sigs = materialize(_signatures(rows, size, fp_size), "signatures")
    keys = sigs.groupBy("sig").agg(F.first("keys").alias("keys")).select("sig", F.explode("keys").alias("key"))
    met = materialize(meetings(keys), "met")
    owners = sigs.join(met.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("row_key").alias("row_key"))
    sets = rows.join(owners, "row_key").dropDuplicates(["sig"]).select("sig", "text")
    sets = materialize(_sets(sets, size), "sets")
    enough = lambda size, sizes, both: least.denominator * both >= least.numerator * (sizes + size - both)
    joined = linked(met, sets, lambda pairs: _verified(pairs, sets, least), enough)
    classes = sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")).join(joined.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    classes = materialize(classes, "classes")
    merged = met_in_balls(classes, sigs).select(F.col("node").alias("root"), F.col("root").alias("upper"))
    classes = materialize(classes.join(merged, "root", "left").select("sig", "rep", F.coalesce("upper", "root").alias("root")), "merged")
    owner = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return sigs.select("doc_id", "sig").join(classes.join(owner, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; all columns, in their order.

    Rows without an id stay; of rows that repeat a kept id all stay.
    """
    lost = near_duplicates(docs, size, least).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
