"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word
shingles. To find every pair of fingerprints that differ in at most ``2 * r`` bits, each *distinct*
fingerprint emits its whole Hamming ball of radius ``r`` (here 1: itself and its 64 one-bit
neighbours). Two fingerprints within distance 2 always share a variant, so a shuffle on the variant
brings every linked pair together; a variant is shared by at most 65 fingerprints, whatever the data
hold. Within a variant, neighbours in sorted order are linked (their distance is verified), which
keeps the components without emitting all pairs. Copies collapse to one fingerprint before anything
is emitted, so the largest group of copies costs no more than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, materialize, text_bytes

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text given as UTF-8 bytes; 0 if it has no words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    norm = b" ".join(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(norm, SEED)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    total = n - shingle_words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        to = min(total, at + _CHUNK)
        hashes = np.array([digest(norm[a:b], SEED) for a, b in zip(starts[at:to], ends[at + shingle_words - 1 : to + shingle_words - 1], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = text_bytes(docs, "doc_id")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints at most two bits apart, enough to connect all such pairs."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    # 65 rows come of each fingerprint, so the distinct ones are dealt out anew: a small shuffle would be merged into few tasks
    one = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = one.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    near = balls.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def balls(fps: DataFrame) -> DataFrame:
    """``(fp, ball)`` of every distinct fingerprint: those linked, directly or through others, share a ball."""
    roots = materialize(components(links(fps)), "balls").select(F.col("node").alias("fp"), "root")
    return fps.select("fp").distinct().join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("ball"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Rows link where fingerprints differ in at most 2 bits; ``component_id`` is the least ``doc_id``
    reachable (null only if no row reachable has an id). Null and empty texts have fingerprint zero
    and link like any other. Repeated rows and ids are kept as they come; other columns are ignored.
    An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(fps))
    # only linked fingerprints go through the component table; the rest stand for themselves
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "classes")
    owner = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    owned = classes.join(owner, "root").select("fp", "component_id")
    return fps.join(owned, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; all columns, in their order.

    Rows without an id have nothing to be told apart by and stay, unless their component has an id.
    Of rows that repeat a kept id all stay.
    """
    found = near_duplicates(docs, shingle_words)
    lost = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
