"""Language-model scores from a weighted backoff automaton over all training texts.

The model is a smoothed trigram. With c the counts over every training token, N their number, V the
distinct ones and k2, k3 fitted below,

    P1(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P2(w | v)  = (c(v w) + k2 P1(w)) / (c(v) + k2)            if c(v) > 0, else P1(w)
    P3(w | uv) = (c(u v w) + k3 P2(w | v)) / (c(u v) + k3)    if c(u v) > 0, else P2(w | v)

each of which sums to one. As an automaton: every word and every pair of words seen in training is a
state, named by the words last read, and there is a root. A state has an arc for every word that
followed it, weighted log10 P, which leads to the longest state that the words read then end in; and a
failure arc to its suffix (a pair's to its second word, a word's to the root), weighted log10 of the
share that the state gives up: k / (c + k). The root has an arc for every word. A text is read once
from left to right: take the arc of the state if it has one for the word, else follow failure arcs, adding
up weights. Arc and failure weights multiply to exactly the P above, as an arc missing has count zero.

k2 and k3 are fitted to counts of counts: if each training n-gram in turn were left out, those seen once
would be missing, and the failure shares predict how many that is. k solves

    sum over histories h of  c(h) k / (c(h) - 1 + k)  =  the n-grams of that order seen once.

Counts cover all training texts and no n-gram is dropped, so the model grows with the input and is
never held in one place. Texts are cut into blocks of about ``BLOCK_TOKENS`` tokens. A block sends its
distinct words, pairs and triples, as hashes with their counts in packed arrays, to hash buckets; a
bucket adds up what the blocks sent and answers each block with the rest of the world's counts, in the
order in which the block listed them. With these answers a block builds the part of the automaton that
its texts can reach, and its texts are read through it side by side. However common an n-gram is, it is
one entry of a block. Buckets grow in number with the input, not in size; a hash keeps ``LOW_BITS``
bits beside its bucket, so the chance that two n-grams of a bucket are taken for one stays at about
``BUCKET_ENTRIES / 2**LOW_BITS`` (4e-6) at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_type, in_fold, materialize, text_bytes

BLOCK_TOKENS = 1 << 19
BUCKET_ENTRIES = 1 << 20
LOW_BITS = 38
ALPHA = 0.1
END = b""  # the end of a text, as a word that no text holds
#: What a block lists: words (but END, whose count is the number of texts), pairs, pairs that end a text, triples.
_WORDS, _PAIRS, _ENDINGS, _TRIPLES = range(4)
_KINDS = (_WORDS, _PAIRS, _ENDINGS, _TRIPLES)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_LOW = np.uint64((1 << LOW_BITS) - 1)
_BINS = 1000  # bins of the counts of counts, per kind; counts up to _EXACT have one each
_EXACT = 64


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_list(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts, by byte planes: the high planes are nearly all zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, n).T for x, kind, n in ((steps, "<u8", 8), (counts, "<u4", 4))]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unpack_list(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = _unpack(data, "u1").reshape(12, -1)
    steps = np.ascontiguousarray(planes[:8].T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u4").ravel()


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * _MIX[0] + (right ^ (right >> np.uint64(29))) * _MIX[1]
    return (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]


class Block:
    """Texts as word numbers: ``words`` distinct words (the last is END), ``ids`` all tokens with an END after each text."""

    def __init__(self, words: list[bytes], ids: np.ndarray, lens: np.ndarray, train: np.ndarray):
        self.words, self.ids, self.lens, self.train = words, ids.astype(np.int64), lens, train
        self.doc = np.repeat(np.arange(len(lens)), lens)
        weight = train[self.doc].astype(np.int64)
        n = self.n = len(words)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        self.word_counts = np.bincount(self.ids, weights=weight, minlength=n).astype(np.int64)
        # a history is what was read before in the same text; its first words have none
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.pairs, found = np.unique(self.ids[at - 1] * n + self.ids[at], return_inverse=True)
        self.pair_at = np.full(len(ids), -1)
        self.pair_at[at] = found
        self.pair_counts = np.bincount(found, weights=weight[at], minlength=len(self.pairs)).astype(np.int64)
        at = at[self.pair_at[at - 1] >= 0]
        self.triples, found = np.unique(self.pair_at[at - 1] * n + self.ids[at], return_inverse=True)
        self.triple_at = np.full(len(ids), -1)
        self.triple_at[at] = found
        self.triple_counts = np.bincount(found, weights=weight[at], minlength=len(self.triples)).astype(np.int64)
        pair_hashes = _mixed(hashes[self.pairs // n], hashes[self.pairs % n])
        ends = self.pairs % n == n - 1
        self.places = {_WORDS: np.arange(n - 1), _PAIRS: np.flatnonzero(~ends), _ENDINGS: np.flatnonzero(ends), _TRIPLES: np.arange(len(self.triples))}
        self.hashes = {_WORDS: hashes[:-1], _PAIRS: pair_hashes[~ends], _ENDINGS: pair_hashes[ends], _TRIPLES: _mixed(pair_hashes[self.triples // n], hashes[self.triples % n])}

    def counts(self, kind: int) -> np.ndarray:
        return {_WORDS: self.word_counts, _TRIPLES: self.triple_counts}.get(kind, self.pair_counts)[self.places[kind]]

    def listed(self, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which the n-grams of a kind are listed, and their buckets and low bits in that order."""
        hashes = self.hashes[kind]
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        place = (bucket << np.uint64(LOW_BITS)) | (hashes & _LOW)
        order = np.argsort(place, kind="stable")
        return order, bucket[order].astype(np.int64), place[order] & _LOW

    def learn(self, kind: int, buckets: int, others: list[np.ndarray]) -> None:
        """Adds the counts of all other blocks, given in the listed order."""
        if others:
            order, _, _ = self.listed(kind, buckets)
            {_WORDS: self.word_counts, _TRIPLES: self.triple_counts}.get(kind, self.pair_counts)[self.places[kind][order]] += np.concatenate(others)


class Automaton:
    """States are numbers: 0 the root, 1 + i word i, 1 + n + p pair p of the block.

    The block has looked up which pair and which triple each of its tokens ends; these are the arcs that
    a word's or a pair's state may have for the token.
    """

    def __init__(self, block: Block, total: int, distinct: int, texts: int, k2: float, k3: float):
        n = self.n = block.n
        self.block = block
        words, pairs, triples = block.word_counts.copy(), block.pair_counts, block.triple_counts
        words[n - 1] = texts
        self.known = words > 0
        p1 = (words + ALPHA) / (total + ALPHA * (distinct + 1))
        first, last = block.pairs // n, block.pairs % n
        p2 = (pairs + k2 * p1[last]) / (words[first] + k2)
        # a token that ends triple t ends pair shorter[t] too
        shorter = np.zeros(len(triples), np.int64)
        ends = block.triple_at >= 0
        shorter[block.triple_at[ends]] = block.pair_at[ends]
        p3 = (triples + k3 * p2[shorter]) / (pairs[block.triples // n] + k3) if len(triples) else np.empty(0)
        self.root_arcs = np.log10(p1)
        # a last entry stands for "no such arc"
        self.word_arcs, self.has_word_arc = np.append(np.log10(p2), 0.0), np.append(pairs > 0, False)
        self.pair_arcs, self.has_pair_arc = np.append(np.log10(p3), 0.0), np.append(triples > 0, False)
        # a state without counts is never entered; its failure arc weighs nothing
        self.failure = np.concatenate([[0.0], np.where(self.known, np.log10(k2 / (words + k2)), 0.0), np.where(pairs > 0, np.log10(k3 / (pairs + k3)), 0.0)])
        self.suffix = np.concatenate([[0], np.zeros(n, np.int64), 1 + last])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads the tokens at ``at``, each in its state: the next states and the weights."""
        word, pair, triple = self.block.ids[at], self.block.pair_at[at], self.block.triple_at[at]
        deep = state > self.n
        long = deep & self.has_pair_arc[triple]
        weight = np.where(deep & ~long, self.failure[state], 0.0)
        state = np.where(deep, self.suffix[state], state)
        short = (state > 0) & ~long & self.has_word_arc[pair]
        none = ~long & ~short
        weight += np.where(long, self.pair_arcs[triple], np.where(short, self.word_arcs[pair], self.root_arcs[word] + np.where(none, self.failure[state], 0.0)))
        return np.where(none, np.where(self.known[word], 1 + word, 0), 1 + self.n + pair), weight

    def finish(self, state: int, start: int, stop: int) -> float:
        """Reads one text's tokens from ``start`` on, a word at a time; the weight."""
        n, total, cut = self.n, 0.0, slice(start, stop)
        for word, pair, triple in zip(self.block.ids[cut].tolist(), self.block.pair_at[cut].tolist(), self.block.triple_at[cut].tolist(), strict=True):
            if state > n:
                if self.has_pair_arc[triple]:
                    total += self.pair_arcs[triple]
                    state = 1 + n + pair
                    continue
                total += self.failure[state]
                state = self.suffix[state]
            if state and self.has_word_arc[pair]:
                total += self.word_arcs[pair]
                state = 1 + n + pair
                continue
            total += self.failure[state] + self.root_arcs[word]
            state = 1 + word if self.known[word] else 0
        return total

    def read(self, few: int = 24) -> np.ndarray:
        """The weight of each text, in one traversal from the root: all texts side by side, the ``few`` longest ends one by one."""
        lens = self.block.lens
        order = np.argsort(-lens, kind="stable")
        starts, left = (np.cumsum(lens) - lens)[order], lens[order]
        state, score = np.zeros(len(lens), np.int64), np.zeros(len(lens))
        running, at = len(lens), 0
        while True:
            while running and left[running - 1] <= at:
                running -= 1
            if running <= few:
                break
            state[:running], weight = self.step(state[:running], starts[:running] + at)
            score[:running] += weight
            at += 1
        for k in range(running):
            score[k] += self.finish(int(state[k]), int(starts[k]) + at, int(starts[k] + left[k]))
        out = np.empty(len(lens))
        out[order] = score
        return out


def _rows_to_blocks(rows: DataFrame) -> DataFrame:
    """``(block, doc_ids, lens, train, ids, words, n_tokens, n_words, n_learn, n_texts)``: one row a block, named by its content."""
    names = ["block", "doc_ids", "lens", "train", "ids", "words", "n_tokens", "n_words", "n_learn", "n_texts"]
    id_type = arrow_type(rows, "doc_id")

    def out(docs, lens, train, parts, numbers):
        ids = np.concatenate(parts).astype("<i4")
        ids[ids < 0] = len(numbers)
        words = zstandard.ZstdCompressor(level=1).compress(b" ".join(numbers))
        packed = _pack(ids)
        name = xxhash.xxh64(packed)
        name.update(words)
        name.update(repr(docs).encode())
        learn = [sum(n for n, t in zip(lens, train, strict=True) if t), sum(train)]
        columns = [[name.intdigest() - (1 << 63)], [docs], [_pack(np.array(lens, "<i4"))], [_pack(np.array(train, "u1"))], [packed], [words], [len(ids)], [len(numbers)], *[[x] for x in learn]]
        kinds = [pa.int64(), pa.list_(id_type), *[pa.binary()] * 4, *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        docs, lens, train, parts, total, numbers = [], [], [], [], 0, {}
        for batch in batches:
            for doc_id, learn, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                found = [numbers.setdefault(w, len(numbers)) for w in tokens(text)]
                found.append(-1)
                docs.append(doc_id)
                lens.append(len(found))
                train.append(learn)
                parts.append(np.array(found, np.int32))
                total += len(found)
                if total >= BLOCK_TOKENS:
                    yield out(docs, lens, train, parts, numbers)
                    docs, lens, train, parts, total, numbers = [], [], [], [], 0, {}
        if docs:
            yield out(docs, lens, train, parts, numbers)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"block long, doc_ids array<{kind}>, lens binary, train binary, ids binary, words binary, n_tokens long, n_words long, n_learn long, n_texts long")


def _open(lens: bytes, train: bytes, ids: bytes, words: bytes) -> Block:
    packed = zstandard.ZstdDecompressor().decompress(words) if words else b""
    return Block([*(packed.split(b" ") if packed else []), END], _unpack(ids, "<i4"), _unpack(lens, "<i4").astype(np.int64), _unpack(train, "u1").astype(bool))


def _requests(blocks: DataFrame, buckets: dict[int, int]) -> DataFrame:
    """``(kind, bucket, block, listed)``: what each block lists, by the bucket of the hash."""
    names = ["kind", "bucket", "block", "listed"]

    def run(batches):
        for batch in batches:
            for name, lens, train, ids, words in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                block = _open(lens, train, ids, words)
                for kind in _KINDS:
                    order, bucket, low = block.listed(kind, buckets[kind])
                    counts = block.counts(kind)[order]
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = [*cuts[1:].tolist(), len(low)] if len(low) else []
                    found = [(kind, int(bucket[a]), name, _pack_list(low[a:b], counts[a:b])) for a, b in zip(cuts.tolist(), ends, strict=True)]
                    for at in range(0, len(found), 64):
                        columns = list(zip(*found[at : at + 64], strict=True))
                        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return blocks.select("block", "lens", "train", "ids", "words").mapInArrow(run, "kind int, bucket int, block long, listed binary")


def _bins(totals: np.ndarray) -> np.ndarray:
    """The bin of each count: its own up to ``_EXACT``, then eight to a doubling."""
    return np.where(totals <= _EXACT, totals, _EXACT + np.floor(8 * np.log2(np.maximum(totals, 1) / _EXACT)).astype(np.int64))


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: adds up the counts of equal keys and gives each block the counts of all others."""
    keys, counts = zip(*[_unpack_list(x) for x in table.column("listed").to_pylist()], strict=True)
    sizes = [len(k) for k in keys]
    counts = np.concatenate(counts).astype(np.int64)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    others = np.split(totals[inverse] - counts, np.cumsum(sizes)[:-1])
    kind = table.column("kind")[0].as_py()
    bins = _bins(totals[totals > 0])
    held, sums = np.bincount(bins), np.bincount(bins, weights=totals[totals > 0])
    stats = [{"bin": kind * _BINS + int(b), "n": int(held[b]), "total": int(sums[b])} for b in np.flatnonzero(held)]
    return pa.table({
        "kind": table.column("kind"), "bucket": table.column("bucket"), "block": table.column("block"), "others": pa.array([_pack(o.astype("<i8")) for o in others], pa.binary()),
        "stats": pa.array([stats, *[None] * (len(others) - 1)], pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))),
    })


def fitted(histories: list[tuple[float, int]], once: int) -> float:
    """k such that the failure shares of ``(count, how many)`` histories predict ``once`` n-grams seen once."""
    if not histories:
        return 1.0
    c, n = (np.array(x, np.float64) for x in zip(*histories, strict=True))
    low, high = 1e-3, 1e5
    for _ in range(80):
        k = math.sqrt(low * high)
        low, high = (k, high) if (n * c * k / (c - 1 + k)).sum() < once else (low, k)
    return math.sqrt(low * high)


def _scores(blocks: pa.Table, answers: pa.Table, model: tuple, buckets: dict[int, int], id_type: pa.DataType) -> pa.Table:
    total, distinct, texts, k2, k3 = model
    found: dict = {}
    for kind, bucket, others in zip(*[answers.column(c).to_pylist() for c in ("kind", "bucket", "others")], strict=True):
        found.setdefault(kind, {})[bucket] = others
    out: list = []
    for docs, lens, train, ids, words in zip(*[blocks.column(c).to_pylist() for c in ("doc_ids", "lens", "train", "ids", "words")], strict=True):
        block = _open(lens, train, ids, words)
        for kind in _KINDS:
            block.learn(kind, buckets[kind], [_unpack(o, "<i8") for _, o in sorted(found.get(kind, {}).items())])
        automaton = Automaton(block, total, distinct, texts, k2, k3)
        n = len(docs)
        sums = lambda x, doc=block.doc, n=n: np.bincount(doc, weights=x, minlength=n)
        out.append(pa.table({
            "doc_id": pa.array(docs, id_type), "held_out": pa.array(~block.train), "n_tokens": pa.array(block.lens),
            "n_known": pa.array(sums(automaton.known[block.ids]).astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(sums(automaton.root_arcs[block.ids])), "score": pa.array(automaton.read()),
        }))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], id_type), **{c: pa.array([], t) for c, t in _COLUMNS.items()}})


_COLUMNS = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def score(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows outside the held-out fold. Every text ends with one END token, so null and
    empty texts have one token. ``base_score`` is the smoothed unigram log10 probability, ``score``
    the automaton's. Repeated rows count and score as often as they come; without training rows both
    scores rest on the smoothing alone; ids may be of any type; other columns are ignored; an empty
    table gives no rows.
    """
    rows = text_bytes(docs.withColumn("__learn", ~in_fold(F.col("doc_id"), modulus)), "doc_id", "__learn")
    id_type, id_name = arrow_type(rows, "doc_id"), dict(rows.dtypes)["doc_id"]
    blocks = materialize(_rows_to_blocks(rows), "blocks")
    sizes = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_learn", "n_texts")], F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("n_rows"), F.count("*").alias("n_blocks")).first()
    most = {_WORDS: sizes.n_words, _PAIRS: sizes.n_tokens, _ENDINGS: sizes.n_rows, _TRIPLES: sizes.n_tokens}
    buckets = {kind: max(4, -(-n // BUCKET_ENTRIES)) for kind, n in most.items()}
    # as many partitions as there are buckets and blocks, so that a task holds a few of them at every size
    asked = _requests(blocks, buckets).repartition(sum(buckets.values()), "kind", "bucket")
    schema = "kind int, bucket int, block long, others binary, stats array<struct<bin: int, n: long, total: long>>"
    # the lists are the largest thing on the disks, and nothing reads them again
    answers = materialize(asked.groupBy("kind", "bucket").applyInArrow(_answer, schema), "answers", drop_shuffles=True)
    held = answers.where("stats is not null").select(F.inline("stats")).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    # at most _BINS rows a kind
    by_kind = {kind: {r.bin % _BINS: r for r in held if r.bin // _BINS == kind} for kind in _KINDS}
    once = lambda *kinds: sum(by_kind[k][1].n for k in kinds if 1 in by_kind[k])
    histories = lambda kind: [(r.total / r.n, r.n) for r in by_kind[kind].values()]
    distinct = sum(r.n for r in by_kind[_WORDS].values()) + (sizes.n_texts > 0)
    model = (sizes.n_learn, distinct, sizes.n_texts, fitted(histories(_WORDS), once(_PAIRS, _ENDINGS)), fitted(histories(_PAIRS), once(_TRIPLES)))
    schema = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = max(1, sizes.n_blocks)
    left = blocks.select("block", "doc_ids", "lens", "train", "ids", "words").repartition(parts, "block")
    right = answers.select("block", "kind", "bucket", "others").repartition(parts, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b, model, buckets, id_type), schema)
