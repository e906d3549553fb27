"""Vector scoring and exact top-k, one query or a batch, whole tables or pruned ones.

A single query is one projection and a ``TakeOrderedAndProject``. A batch is scored in Arrow blocks by
matrix products, each block keeping its own k best for each query, so that only ``blocks * queries * k``
rows are shuffled. Ties go to the lower ``row_id`` everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import ship_package

#: Queries that one pass takes: larger batches go in several passes, so what is broadcast stays bounded.
QUERY_BLOCK = 1024


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null for a vector without length or with a part that is no number."""
    size = norm(a)
    return F.when((size > 0) & ~F.isnan(size), F.transform(a, lambda x: x.cast("double") / size))


def checked_query(values, width: int | None = None) -> list[float] | None:
    """A query at unit length; None for a zero or undefined one; a wrong width is an error."""
    q = np.asarray(values, np.float64).ravel()
    if width is not None and q.size != width:
        raise ValueError(f"query has {q.size} dims, the table has {width}")
    size = float(np.linalg.norm(q))
    return (q / size).tolist() if np.isfinite(size) and size > 0 else None


def legacy_score(cosine: Column) -> Column:
    return 0.6 * cosine + 0.4 * F.signum(cosine) * F.pow(F.abs(cosine), F.lit(13.0))


def legacy_inverse(score: float, steps: int = 60) -> float:
    """The cosine whose legacy score is ``score``, by halving."""
    low, high = -1.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.6 * mid + 0.4 * np.sign(mid) * abs(mid) ** 13 < score else (low, mid)
    return (low + high) / 2


def scored(facts: DataFrame, query, column: str = "embedding") -> DataFrame:
    """Adds ``cosine`` of unit rows with one query (a list of numbers, or None for an undefined query: no rows)."""
    if query is None:
        return facts.withColumn("cosine", F.lit(None).cast("double")).where(F.lit(False))
    return facts.withColumn("cosine", dot(F.col(column), literal_vector(query)))


def top_k(rows: DataFrame, score: str, k: int, tie: str = "row_id") -> DataFrame:
    """The k best rows in order, ties by ascending ``tie``; none for a k below one."""
    return rows.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(max(0, k))


def late_top_k(facts: DataFrame, query, k: int, key: str, column: str = "embedding") -> DataFrame:
    """Top-k on the key and score alone, then the wide columns of those k rows: the scan reads no text for the rest."""
    best = top_k(scored(facts.select(key, column), query, column), "cosine", k, key).select(key, "cosine")
    # the broadcast side has k rows
    return facts.drop(column).join(F.broadcast(best), key)


def floor_counts(rows: DataFrame, score: str, floor: float, k: int) -> DataFrame:
    """One row: ``n_above_floor``, ``returned``, ``truncated``."""
    return rows.agg(F.count_if(F.col(score) >= floor).alias("n_above_floor")).select("n_above_floor", F.least("n_above_floor", F.lit(max(0, k)).cast("long")).alias("returned"), (F.col("n_above_floor") > max(0, k)).alias("truncated"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def batch_top_k(facts: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "row_id", column: str = "embedding", floor: float | None = None) -> DataFrame:
    """``(qid, key, cosine, rank)``: the k best rows of each query, ranked from 1."""
    ship_package(facts.sparkSession)
    kind = dict(facts.dtypes)[key]
    out = None
    for at in range(0, len(queries), QUERY_BLOCK):
        part = queries[at : at + QUERY_BLOCK]
        qids = np.array([q for q, _ in part], np.int64)
        held = facts.sparkSession.sparkContext.broadcast(np.array([v for _, v in part], np.float64).T)

        def run(batches, qids=qids, held=held):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cosine = _matrix(batch.column(1)) @ held.value
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((np.broadcast_to(keys[:, None], cosine.shape), -cosine), axis=0)[:k]
                best = np.take_along_axis(cosine, order, 0)
                keep = np.ones(best.shape, bool) if floor is None else best >= floor
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qids, best.shape)[keep]), batch.column(0).take(pa.array(order[keep])), pa.array(best[keep])], ["qid", key, "cosine"])

        found = facts.select(key, column).where(F.col(column).isNotNull()).mapInArrow(run, f"qid long, {key} {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return facts.sparkSession.createDataFrame([], f"qid long, {key} {kind}, cosine double, rank int")
    best = Window.partitionBy("qid").orderBy(F.col("cosine").desc(), F.col(key).asc())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def quantised(facts: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds ``codes`` (whole numbers within 127) and ``scale`` so that ``codes * scale`` is near the vector."""
    top = F.array_max(F.transform(column, lambda x: F.abs(x).cast("double")))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return facts.withColumn("scale", scale).withColumn("codes", F.transform(column, lambda x: F.round(x.cast("double") / F.col("scale")).cast("tinyint")))


def quantised_top_k(facts: DataFrame, query, k: int, key: str = "row_id", column: str = "embedding", pool: int = 512) -> DataFrame:
    """Top-k by the quantised scan, its ``pool`` best ranked anew by their exact cosines."""
    rough = quantised(facts.select(key, column), column).withColumn("rough", dot(F.col("codes"), literal_vector(query)) * F.col("scale"))
    pooled = rough.orderBy(F.col("rough").desc(), F.col(key).asc()).limit(max(pool, k))
    return top_k(scored(pooled, query, column), "cosine", k, key).select(key, "cosine")


def second_moment(facts: DataFrame, column: str = "embedding") -> np.ndarray:
    """The uncentred second-moment matrix of the rows: each block adds up its own, then the blocks are added."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    sums = facts.select(column).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    width = int(round(len(sums) ** 0.5))
    return np.array([r.value for r in sums]).reshape(width, width)


def screen_basis(facts: DataFrame, d_out: int, column: str = "embedding") -> np.ndarray:
    """The leading ``d_out`` eigenvectors of the second moment, one a column."""
    values, vectors = np.linalg.eigh(second_moment(facts, column))
    return vectors[:, np.argsort(-values, kind="stable")[:d_out]]


def with_screen(facts: DataFrame, basis: np.ndarray, column: str = "embedding") -> DataFrame:
    """Adds the screen of each row: ``head``, its projection, and ``rest``, the length of what the projection leaves.

    One matrix product an Arrow batch; a null vector has a null screen.
    """
    held = facts.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("head array<double>, rest double")
    def screen(rows: pd.Series) -> pd.DataFrame:
        known = rows.notna().to_numpy()
        x = np.stack(rows[known].to_list()).astype(np.float64) if known.any() else np.zeros((0, held.value.shape[0]))
        head = x @ held.value
        rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (head * head).sum(axis=1), 0.0))
        found = iter(zip(head.tolist(), rest.tolist(), strict=True))
        return pd.DataFrame([next(found) if k else (None, None) for k in known], columns=["head", "rest"])

    shaped = facts.withColumn("__screen", screen(column))
    return shaped.withColumn("head", F.col("__screen.head")).withColumn("rest", F.col("__screen.rest")).drop("__screen")


def screened_top_k(screen: DataFrame, query, basis: np.ndarray, k: int, key: str = "row_id", column: str = "embedding", seed_rows: int = 128, slack: float = 1e-9, most: float = 0.35) -> DataFrame:
    """Exact top-k through the screen.

    ``head . q_head + rest * |q_rest|`` bounds a row's cosine from above. The k-th exact cosine of the
    ``seed_rows`` rows with the best bounds is a floor for the answer, so rows bounded below it are
    dropped before their whole vectors are read. Where more than the share ``most`` of the rows stays
    above the floor, the screen spares nothing and all rows are scanned. The answer equals that of a full scan.
    """
    q = np.asarray(query, np.float64)
    head = basis.T @ q
    rest = float(np.sqrt(max(q @ q - head @ head, 0.0)))
    bounded = screen.withColumn("bound", dot(F.col("head"), literal_vector(head)) + F.col("rest") * F.lit(rest))
    seed = scored(bounded.orderBy(F.col("bound").desc(), F.col(key).asc()).limit(max(seed_rows, k)), query, column)
    # one number: the k-th best exact cosine of the seed
    kth = seed.orderBy(F.col("cosine").desc()).limit(k).agg(F.min("cosine").alias("floor"), F.count("*").alias("n")).first()
    live = screen
    if kth.n == k:
        above = F.col("bound") >= kth.floor - slack
        share = bounded.agg(F.avg(above.cast("double")).alias("share")).first().share
        live = bounded.where(above) if share is not None and share <= most else screen
    return top_k(scored(live, query, column), "cosine", k, key).select(key, "cosine")


#: Cells at most: their centres are held on the driver and the beam is a list of them.
MAX_CELLS = 4096
#: Rows below which a scan is cheaper than a beam, and how many of an attribute's newest rows are always read.
ROUTED_FROM, NEWEST = 50_000, 512
#: The share of true neighbours that a beam must hold for a layout to be used.
COVERAGE = 0.9


def cells(facts: DataFrame, target: int = 25, seed: int = 7, iterations: int = 10, column: str = "embedding", most: int = MAX_CELLS) -> tuple[DataFrame, np.ndarray]:
    """Rows with their ``cell``, and the cell centres, from spherical k-means with ceil(n / target) cells, at most ``most``."""
    n = facts.count()
    rows = facts.withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(featuresCol="__v", predictionCol="cell", k=min(most, max(2, -(-n // target))), seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(rows)
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return model.transform(rows).drop("__v"), centres


def beam(centres: np.ndarray, query, share: float = 0.25, least: int = 4) -> list[int]:
    """The cells to scan: those whose centres are nearest to the query."""
    width = min(len(centres), max(least, int(np.ceil(share * len(centres)))))
    return np.argsort(-(centres @ np.asarray(query)), kind="stable")[:width].tolist()


def routed_top_k(celled: DataFrame, centres: np.ndarray, query, k: int, share: float = 0.25, key: str = "row_id", column: str = "embedding", newer: DataFrame | None = None) -> DataFrame:
    """Top-k over the beam's cells only (a partition filter where the table is laid out by ``cell``) and all ``newer`` rows, which no cell holds."""
    rows = celled.where(F.col("cell").isin(beam(centres, query, share))).select(key, column)
    rows = rows if newer is None else rows.unionByName(newer.select(key, column))
    return top_k(scored(rows, query, column), "cosine", k, key).select(key, "cosine")


def share_for(celled: DataFrame, centres: np.ndarray, coverage: float = COVERAGE, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), **options) -> float:
    """The least of ``shares`` whose beams hold so many of the true neighbours of sampled rows."""
    return next((s for s in shares if (nn_coverage(celled, centres, s, **options).first().coverage or 0.0) >= coverage), 1.0)


@dataclass
class Layout:
    """A table laid out by cells: its rows with ``cell``, the centres, the highest key that it holds, and the beam's share."""

    celled: DataFrame
    centres: np.ndarray
    top: int
    share: float


def layout(facts: DataFrame, key: str = "row_id", column: str = "embedding", coverage: float = COVERAGE, share: float = 0.25) -> Layout | None:
    """Cells for a table, or None if a beam of ``share`` of them holds too few of the true neighbours."""
    celled, centres = cells(facts, column=column)
    if (nn_coverage(celled, centres, share, key=key, column=column).first().coverage or 0.0) < coverage:
        return None
    return Layout(celled, centres, celled.agg(F.max(key).alias("top")).first().top or 0, share)


def mode(n: int, found: Layout | None, router: str = "auto", filtered: bool = False) -> str:
    """``cells`` or ``scan``: cells only with a layout, an unfiltered question and, on ``auto``, a table large enough."""
    if router not in ("auto", "on", "off"):
        raise ValueError(f"router must be auto, on or off, not {router!r}")
    if found is None or filtered or router == "off":
        return "scan"
    return "cells" if router == "on" or n > ROUTED_FROM else "scan"


def auto_top_k(facts: DataFrame, found: Layout | None, query, k: int, router: str = "auto", filtered: bool = False, entities: list[str] | None = None, key: str = "row_id", column: str = "embedding") -> DataFrame:
    """Top-k by the mode that fits: a scan, or a beam with all rows newer than the layout and the newest of the asked attributes."""
    if mode(facts.count() if router == "auto" else 0, found, router, filtered) == "scan":
        return top_k(scored(facts.select(key, column), query, column), "cosine", k, key).select(key, "cosine")
    newer = facts.where(F.col(key) > found.top).select(key, column)
    if entities:
        newer = newer.unionByName(facts.where(F.col("entity").isin(entities)).orderBy(F.col(key).desc()).limit(NEWEST).select(key, column))
    wide = routed_top_k(found.celled, found.centres, query, k + NEWEST, found.share, key, column, newer)
    return top_k(wide.dropDuplicates([key]), "cosine", k, key)


def recluster(celled: DataFrame, partitions: int, key: str = "row_id") -> DataFrame:
    """Rows laid out by cell, then key."""
    return celled.repartitionByRange(partitions, "cell", key).sortWithinPartitions("cell", key)


def nn_coverage(celled: DataFrame, centres: np.ndarray, share: float, sample: int = 200, neighbours: int = 5, key: str = "row_id", column: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """One row: the share of sampled rows' (or ``queries``') true nearest neighbours that lie in the cells of their beams."""
    chosen = celled.orderBy(F.xxhash64(F.col(key)), key).limit(sample) if queries is None else queries
    picked = [(r[key], list(r[column])) for r in chosen.select(key, column).collect()]
    near = batch_top_k(celled, picked, neighbours + 1, key, column).where(F.col("qid") != F.col(key))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= neighbours)
    beams = celled.sparkSession.createDataFrame([(q, beam(centres, v, share)) for q, v in picked], "qid long, beam array<int>")
    held = near.join(celled.select(key, "cell"), key).join(F.broadcast(beams), "qid")
    return held.agg(F.avg(F.array_contains("beam", F.col("cell")).cast("double")).alias("coverage"), F.count("*").alias("pairs"))


def half_precision(column: Column) -> Column:
    """The vector as it reads back from half-precision storage."""

    @F.pandas_udf("array<float>")
    def through(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.asarray(v, np.float16).astype(np.float32).tolist(), na_action="ignore")

    return through(column)


def page_scores(scored_rows: DataFrame, page_rows: int = 50, pool: str = "max", power: float = 8.0, key: str = "row_id") -> DataFrame:
    """``(page, page_score)`` of pages of ``page_rows`` neighbouring rows: their best cosine, or the power mean of those above zero."""
    page = F.floor(F.col(key) / page_rows).alias("page")
    best = F.max("cosine") if pool == "max" else F.pow(F.avg(F.pow(F.greatest(F.col("cosine"), F.lit(0.0)), F.lit(power))), F.lit(1 / power))
    return scored_rows.groupBy(page).agg(best.alias("page_score"))


def paged_top_k(facts: DataFrame, query, k: int, pages: int, page_rows: int = 50, pool: str = "max", key: str = "row_id", column: str = "embedding") -> DataFrame:
    """Top-k over the rows of the ``pages`` best pages. With the pool ``max`` and at least k pages it is exact but for ties."""
    rows = scored(facts, query, column)
    best = page_scores(rows, page_rows, pool, key=key).orderBy(F.col("page_score").desc(), "page").limit(pages)
    inside = rows.withColumn("page", F.floor(F.col(key) / page_rows)).join(F.broadcast(best.select("page")), "page", "left_semi")
    return top_k(inside, "cosine", k, key).select(key, "cosine")
