"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts become hashed term vectors (words, word shapes, immediate repeats, variety), weighted by inverse
document frequency and projected on the leading singular directions of a bounded labelled sample. The
labelled vectors are broadcast (at most ``SAMPLE`` of them); every document's cosine with every
labelled vector is computed exactly in blocks, and its ``neighbours`` nearest vote with their
labels, weighted by similarity. Scoring is a single pass over the table without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_fold, text_bytes

TERMS = 1 << 13
#: Labelled documents that are kept as voters, at most (half of either label).
SAMPLE = 2000
RANK = 48
_CACHE = 400_000
_SHAPES = ((re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Xx0])+"), b"."))


def _shape(word: bytes) -> bytes:
    """Runs of upper case, lower case and digits as one sign each; other signs stay, runs of them once."""
    out = word
    for pattern, sign in _SHAPES[:3]:
        out = pattern.sub(sign, out)
    return re.sub(rb"(.)\1+", rb"\1", out)


class Terms(dict):
    """Word to its two term numbers (word, shape), remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = (zlib.crc32(word.lower()) % (TERMS - 512) + 512, zlib.crc32(_shape(word)) % 448)
        if len(self) < _CACHE:
            self[word] = found
        return found


def term_counts(text: bytes, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers (ascending) and their damped counts for a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    ids, counts = np.unique(np.array([terms[w] for w in words], np.int64), return_counts=True)
    weights = np.log1p(counts).astype(np.float32)
    weights[ids < 512] *= 3.0  # shapes are few and carry the layout of a text
    repeats = sum(map(bytes.__eq__, words[1:], words)) / n
    variety = len(set(words)) / n**0.8
    marks = [448 + min(int(repeats * 16), 15), 464 + min(int(variety * 12), 15), 480 + min(n.bit_length(), 24)]
    keep = np.concatenate([ids, marks])
    extra = np.float32([4.0, 2.0, 1.0])
    order = np.argsort(keep, kind="stable")
    return keep[order], np.concatenate([weights, extra])[order]


@dataclass
class Model:
    basis: np.ndarray  # TERMS x rank, weighted by inverse document frequency
    voters: np.ndarray  # unit vectors, rank x voters
    labels: np.ndarray
    prior: float


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Learn from labelled rows outside the held-out fold, at most ``sample // 2`` of either label by a hash of the id.

    Null ids and labels are left out; of rows that repeat an id the one with the least text hash is used;
    ids may be of any type.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~in_fold(F.col("doc_id"), modulus))
    one = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    part = lambda k: one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    picked = part(0).union(part(1))
    # bounded by ``sample`` ids, whatever the tables hold
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = text_bytes(rows.withColumn("place", F.xxhash64("doc_id")), "place", "label")

    def run(batches):
        terms = Terms()
        for batch in batches:
            found = [term_counts(t, terms) for t in batch.column(2).to_pylist()]
            ids, weights = (pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in ((0, "<i4"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, weights], ["place", "label", "ids", "weights"])

    got = sorted(rows.mapInArrow(run, "place long, label int, ids binary, weights binary").collect(), key=lambda r: (r.place, r.label, bytes(r.ids)))
    n = len(got)
    x = np.zeros((n, TERMS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(bytes(r.ids), "<i4")] = np.frombuffer(bytes(r.weights), "<f4")
    marks = np.array([r.label for r in got], np.float64)
    if not n:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((1, 0), np.float32), marks, 0.5)
    idf = (np.log((n + 1) / ((x > 0).sum(axis=0) + 1)) + 0.1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    values, left = values[::-1][:rank], left[:, ::-1][:, :rank]
    good = values > 1e-6 * values[0]
    basis = (x.T @ (left[:, good] / np.sqrt(values[good])).astype(np.float32)).astype(np.float32)
    voters = x @ basis
    voters /= np.maximum(np.linalg.norm(voters, axis=1, keepdims=True), 1e-9)
    return Model((idf[:, None] * basis).astype(np.float32), np.ascontiguousarray(voters.T), marks, float(marks.mean()))


def vote(vectors: np.ndarray, model: Model, neighbours: int = 15, block: int = 512) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest voters; zero vectors get the prior."""
    out = np.full(len(vectors), model.prior)
    n = model.voters.shape[1]
    if not n:
        return out
    k = min(neighbours, n)
    for at in range(0, len(vectors), block):
        part = vectors[at : at + block]
        size = np.linalg.norm(part, axis=1)
        cosine = (part / np.maximum(size, 1e-9)[:, None]) @ model.voters
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0) ** 4
        total = weight.sum(axis=1)
        score = (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        out[at : at + block] = np.where((size > 1e-6) & (total > 1e-12), np.clip(score, 0.0, 1.0), model.prior)
    return out


def score(docs: DataFrame, model: Model, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    ``score`` is in [0, 1], higher where label 1 is likelier; null and empty texts get the share of
    label 1 among the voters. Ties among neighbours beyond the last place don't change a score by
    more than their equal similarity. Repeated rows score alike; other columns are never read; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        terms, model = Terms(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            vectors = np.zeros((len(texts), model.basis.shape[1]), np.float32)
            for k, text in enumerate(texts):
                ids, weights = term_counts(text, terms)
                if len(ids):
                    vectors[k] = weights @ model.basis[ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vote(vectors, model), pa.float64())], ["doc_id", "score"])

    rows = text_bytes(docs, "doc_id")
    found = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return found.select("doc_id", in_fold(F.col("doc_id"), modulus).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
