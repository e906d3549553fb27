"""Quality rules: counting rules, then line labelling with a linear-chain conditional random field.

Every line of a text gets a vector of surface features. A two-state chain (content, boilerplate) with
linear emission scores and a 2x2 transition table labels the lines jointly; Viterbi decoding finds
the best labelling, and the document stays if the words on content lines make up at least
``min_content`` of its words.

The chain learns from lines whose labels are known and change within a sequence: documents of good
quality (their lines are content) and of low quality (boilerplate) are spliced, in whole and in parts and
in either order, so that the transitions are those of mixed pages. Weights maximise the conditional
log-likelihood by BFGS. All sequences are one long chain with a reset at every start, whose forward
and backward products are taken by doubling: a step costs a few array operations, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes

#: Labelled documents per class that the fit uses, at most, each with all its lines; scoring reads every text.
SAMPLE_DOCS = 400

_SPACE = b" \t\n\x0b\x0c\r"
_TAIL = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_END = (b".", b"?", b"!", b":", b'"')
FEATURES = 12
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text in UTF-8."""
    words = text.split()
    word_chars = len(text.translate(None, _SPACE + _TAIL))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen, n_dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif not line.isspace() and line:
            seen.add(line)
    n = len(words)
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        first: dict = {}
        again = np.zeros(n + 1, np.int64)
        if len(set(windows)) < len(windows):
            for at, window in enumerate(windows):
                other = first.setdefault(window, at)
                if other != at:
                    for k in (other, at):
                        again[k : k + 3] = 1
            repeated = int(again[:n].sum())
    return n, word_chars, n_symbols, n_dup, repeated


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and word counts of the lines that hold a word, in order."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        symbols = size - len(line.translate(None, _SYMBOLS))
        bangs = line.count(b"!")
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        digits = size - len(line.translate(None, _DIGITS))
        twice = sum(map(bytes.__eq__, words[1:], words))
        rows.append((
            1.0, min(symbols / n, 2.0), min(bangs / n, 2.0), upper / (upper + lower + 1), digits / size, twice / n, 1.0 - len(set(words)) / n,
            min(size / n / 10, 3.0), min(np.log1p(n) / 5, 2.0), float(line.rstrip().endswith(_END)), float(line in seen), float(n < 5),
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.float64)


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best path through ``emit`` (T x 2 scores) under ``trans`` (2 x 2); state 1 is content. Ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    a = b = 0.0
    back = []
    for at, (e0, e1) in enumerate(emit.tolist()):
        if not at:
            a, b = e0, e1
            continue
        to0, to1 = (a + t00, b + t10), (a + t01, b + t11)
        back.append((0 if to0[0] > to0[1] else 1, 0 if to1[0] > to1[1] else 1))
        a, b = max(to0) + e0, max(to1) + e1
    path = np.empty(len(emit), np.int8)
    state = 0 if a > b else 1
    for at in range(len(emit) - 1, -1, -1):
        path[at] = state
        if at:
            state = back[at - 1][state]
    return path


def share(feats: np.ndarray, sizes: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of words on lines that the chain labels content; 0 without words."""
    weights, trans = model
    if not len(sizes):
        return 0.0
    emit = np.stack([np.zeros(len(feats)), feats @ weights], axis=1)
    return float(sizes[viterbi(emit, trans) == 1].sum() / sizes.sum())


def spliced(good: list[np.ndarray], bad: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(feature rows, labels)`` of sequences made of good (1) and low-quality (0) documents.

    Every document comes alone and spliced with one of the other class (the shorter list is used in
    turn): before it, after it, and within it, at its middle line.
    """
    part = lambda rows, label: (rows, np.full(len(rows), label, np.int8))
    out = [[part(rows, label)] for label, docs in ((1, good), (0, bad)) for rows in docs]
    for k in range(max(len(good), len(bad)) if good and bad else 0):
        one, other = part(good[k % len(good)], 1), part(bad[k % len(bad)], 0)
        host, guest = (one, other) if k % 2 else (other, one)
        half = len(host[0]) // 2
        middle = [tuple(x[:half] for x in host), guest, tuple(x[half:] for x in host)]
        out.append([[one, other], [other, one], middle][k % 3])
    return [tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in out]


def _products(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the 2x2 matrices up to each place, scaled to a largest entry of one, and the logarithms of the scales."""
    out, scale, reach = steps.copy(), np.zeros(len(steps)), 1
    while reach < len(out):
        joined = out[:-reach] @ out[reach:]
        top = joined.max(axis=(1, 2))
        scale[reach:] += scale[:-reach] + np.log(top)
        out[reach:] = joined / top[:, None, None]
        reach *= 2
    return out, scale


def likelihood(params: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels and its gradient. ``params``: content weights, then the 2x2 table."""
    weights, trans = params[:-4], params[-4:].reshape(2, 2)
    n = len(x)
    emit = np.stack([np.zeros(n), x @ weights], axis=1)
    high = emit.max(axis=1)
    look = np.exp(emit - high[:, None])
    most = trans.max()
    # a start forgets what came before: both rows of its matrix are the emission
    steps = np.where(first[:, None, None], 1.0, np.exp(trans - most)[None]) * look[:, None, :]
    ahead, scale = _products(steps)
    alpha = ahead.sum(axis=1)
    back = _products(steps[::-1].transpose(0, 2, 1))[0].transpose(0, 2, 1)[::-1]
    beta = np.ones((n, 2))
    beta[:-1] = back[1:].sum(axis=2)
    # the first matrix has two equal rows, hence log 2; each step left its largest entries out
    total = np.log(alpha[-1].sum()) + scale[-1] - np.log(2.0) + high.sum() + most * (~first).sum()
    inner = np.flatnonzero(~first)
    gold = emit[np.arange(n), y].sum() + trans[y[inner - 1], y[inner]].sum()
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    joint = alpha[inner - 1][:, :, None] * steps[inner] * beta[inner][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1.0)
    slope = np.concatenate([x.T @ (marginal[:, 1] - y), (joint.sum(axis=0) - seen).ravel()])
    return (total - gold) / n + 0.5 * ridge * params @ params, slope / n + ridge * params


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, trans)`` by conditional maximum likelihood. ``sequences``: feature rows and labels, line by line."""
    sequences = [(x, y) for x, y in sequences if len(x)]
    if not sequences:
        return np.concatenate([[1.0], np.zeros(FEATURES - 1)]), np.zeros((2, 2))
    x, y = np.concatenate([x for x, _ in sequences]), np.concatenate([y for _, y in sequences]).astype(np.int64)
    first = np.zeros(len(x), bool)
    first[np.cumsum([0, *[len(s) for s, _ in sequences[:-1]]])] = True
    params = np.zeros(FEATURES + 4)
    inverse = np.eye(len(params))
    value, slope = likelihood(params, x, y, first, ridge)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-6:
            break
        move, size = -inverse @ slope, 1.0
        while size > 1e-10:
            after, slope_after = likelihood(params + size * move, x, y, first, ridge)
            if after <= value + 1e-4 * size * (slope @ move):
                break
            size /= 2
        else:
            break
        gained, params, value = slope_after - slope, params + size * move, after
        curve, slope = size * (gained @ move), slope_after
        if curve > 1e-14:
            turn = np.eye(len(params)) - size * np.outer(move, gained) / curve
            inverse = turn @ inverse @ turn.T + size * size * np.outer(move, move) / curve
    return params[:-4], params[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``sample_docs`` labelled documents of either quality, chosen by a hash of their ids.

    Labels and ids that are null are left out; an id with several labels takes their majority (a tie:
    good); of rows that repeat an id the one with the least text hash is used. Ids may be of any type.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = None
    for label in (0, 1):
        part = one.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        picked = part if picked is None else picked.union(part)
    # at most 2 * sample_docs ids: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = text_bytes(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("place", F.xxhash64("doc_id")), "place", "label")

    def run(batches):
        for batch in batches:
            feats = [line_features(t.split(b"\n"))[0].tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary())], ["place", "label", "feats"])

    found = rows.mapInArrow(run, "place long, label int, feats binary").collect()
    found = sorted((r.place, r.label, bytes(r.feats)) for r in found)
    by_class = {k: [np.frombuffer(f, np.float64).reshape(-1, FEATURES) for _, label, f in found if label == k] for k in (0, 1)}
    return fit(spliced(by_class[1], by_class[0]))


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], min_words: int = 50, max_repeat_pct: int = 50, min_content: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the ``keep`` columns, the counts, ``content_share``, ``base_failed``, ``kept``.

    A text that is null or has no words counts zero everywhere and fails the base rules. Texts are
    read whole; repeated rows are judged alike; columns beside ``keep`` and ``text`` are ignored; an
    empty table gives no rows.
    """
    names = [*keep, *COUNTS, "content_share"]
    rows = text_bytes(docs, *keep)

    def run(batches):
        for batch in batches:
            out, shares = [], []
            for text in batch.column(len(keep)).to_pylist():
                out.append(counts(text))
                feats, sizes = line_features(text.split(b"\n"))
                shares.append(share(feats, sizes, model))
            table = np.array(out, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *[pa.array(table[:, k]) for k in range(len(COUNTS))], pa.array(shares, pa.float64())], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], *[f"{c} long" for c in COUNTS], "content_share double"])
    found = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_content))


def filter_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; nothing is shuffled."""
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col("text"))
    judged = judge(whole, model, keep=tuple(f"c{k}" for k in range(len(docs.columns))), **rules)
    return judged.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
