"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are words (A-Z lower-cased, punctuation dropped). The CGK embedding walks along a
word sequence: at each of its steps it writes the current word and moves on by a random bit that
depends on the step and the word, so two sequences a few edits apart write strings that differ in few
places. A hash of ``SAMPLED`` random places of that string is a bit-sampling LSH key; windows and
items with an equal key in any table are candidates. The longer the sequence, the further two walks
drift apart, so items are embedded in pieces of at most ``PIECE`` words: if a fifth of an item's words
is edited, at least one piece has no more than a fifth of its own edited, and most often several do.
A piece at the limit is found by ``WALKS * DRAWS`` tables with a chance of about 99 %, closer ones more surely,
exact ones always.

Candidates are verified exactly: the least word edit distance between the whole item and any stretch
of the text around the place that the piece points to (bit-parallel dynamic programming) must be
within ``max_edit`` of the item's words.

Items are few and broadcast in blocks of at most ``BLOCK_ITEMS``; documents are read once per block and
never shuffled. Before the walk, a lossless count passes windows over: an edit breaks at most two word
pairs of a piece, so a window that begins a match within d edits of a piece of n words holds at least
n - 1 - 2d pairs of neighbouring words that occur in some item.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_type, text_bytes

MAX_EDIT = 0.2
#: Shorter items occur by chance: they are found (whole and unchanged), but spoil no document in :func:`drop_contaminated`.
MIN_WORDS = 5
PIECE = 16
WALKS, DRAWS, SAMPLED = 6, 4, 3
BLOCK_ITEMS = 20_000
_GROWTH = 1.25
_POSITIONS = 1 << 20
_PUNCTUATION = b".,;:!?\"'()[]{}"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


@dataclass
class Group:
    """Pieces of about one length: windows have ``size`` words, the length of the shortest."""

    size: int
    edits: int
    places: list[list[np.ndarray]] = field(default_factory=list)  # walk -> draw -> sorted steps
    keys: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)  # walk -> draw -> sorted keys, their pieces


@dataclass
class Index:
    ids: dict[bytes, int]
    names: list
    items: list[np.ndarray]
    edits: list[int]
    groups: list[Group]
    factors: np.ndarray
    pad: int
    pairs: np.ndarray  # marks of the neighbouring words of all items, by hash
    item_of: np.ndarray  # the item of each piece
    offset: np.ndarray  # where in its item a piece begins
    item_pairs: list[frozenset]  # the neighbouring words of each item


def _pair_slots(flat: np.ndarray, size: int) -> np.ndarray:
    """The slot, of ``size`` (a power of two), of every word with the next one."""
    words = flat.astype(np.uint64)
    mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size.bit_length() + 1)


def _pair_codes(flat: np.ndarray, pad: int) -> np.ndarray:
    """A number for every word with the next one."""
    return flat[:-1] * (pad + 1) + flat[1:]


def _walk(flat: np.ndarray, starts: np.ndarray, size: int, pad: int, factors: np.ndarray, draws: list[np.ndarray]) -> list[np.ndarray]:
    """LSH keys of the windows at ``starts``, one array a draw, by one walk of ``2 * size`` steps."""
    at = np.zeros(len(starts), np.int64)
    keys = [np.zeros(len(starts), np.uint64) for _ in draws]
    wanted = [set(d.tolist()) for d in draws]
    for step in range(1 + max(int(d[-1]) for d in draws)):
        word = np.where(at < size, flat[np.minimum(starts + at, len(flat) - 1)], pad).astype(np.uint64)
        for key, steps in zip(keys, wanted, strict=True):
            if step in steps:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= word + np.uint64(1)
        mixed = (word + np.uint64(1)) * factors[step]
        at += ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(33)).astype(np.int64) & 1
    return keys


def build(items: list[tuple[object, bytes]], max_edit: float = MAX_EDIT, min_words: int = 1, seed: int = 5) -> Index:
    """Index of ``(item id, text)``; items of fewer than ``min_words`` words match nothing."""
    rng = np.random.default_rng(seed)
    ids: dict[bytes, int] = {}
    names, coded = [], []
    for name, text in items:
        words = words_of(text)
        if len(words) >= max(min_words, 1):
            names.append(name)
            coded.append(np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int64))
    edits = [int(max_edit * len(c) + 1e-9) for c in coded]
    pieces = [(k, int(cut[0]), len(cut)) for k, c in enumerate(coded) for cut in np.array_split(np.arange(len(c)), -(-len(c) // PIECE))]
    pad = len(ids) + 1
    factors = rng.integers(1, 1 << 63, (WALKS, 2 * PIECE), dtype=np.uint64) | np.uint64(1)
    groups, size = [], 1
    while size <= PIECE:
        top = max(size + 1, int(size * _GROWTH) + 1)
        inside = [k for k, (_, _, n) in enumerate(pieces) if size <= n < top]
        if inside:
            group = Group(size, max(int(max_edit * pieces[k][2] + 1e-9) for k in inside))
            flat = np.concatenate([coded[pieces[k][0]][pieces[k][1] : pieces[k][1] + pieces[k][2]] for k in inside])
            starts = np.cumsum([0, *[pieces[k][2] for k in inside[:-1]]])
            for walk in range(WALKS):
                draws = [np.sort(rng.choice(2 * size, min(SAMPLED, 2 * size), replace=False)) for _ in range(DRAWS)]
                found = _walk(flat, starts, size, pad, factors[walk], draws)
                group.places.append(draws)
                order = [np.argsort(k, kind="stable") for k in found]
                group.keys.append([(k[o], np.array(inside)[o]) for k, o in zip(found, order, strict=True)])
            groups.append(group)
        size = top
    pairs = np.zeros(1 << max(16, sum(map(len, coded)).bit_length() + 6), bool)
    for code in coded:
        pairs[_pair_slots(code, len(pairs))] = True
    return Index(ids, names, coded, edits, groups, factors, pad, pairs, np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64), [frozenset(_pair_codes(c, pad).tolist()) for c in coded])


def best_edit(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edit distance between ``item`` and any stretch of ``text``, and where that stretch ends."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(xv | up)) & full, up & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def _candidates(flat: np.ndarray, index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(starts, pieces)`` arrays of windows that share an LSH key with a piece."""
    inside = (flat > 0) & (flat < index.pad)
    shared = np.flatnonzero(inside[:-1] & inside[1:])
    shared = shared[index.pairs[_pair_slots(flat, len(index.pairs))[shared]]]
    known = np.zeros(len(flat) + 1, np.int64)
    known[shared + 1] = 1
    known = np.cumsum(known)
    out = []
    for group in index.groups:
        last = len(flat) - group.size
        if last < 0:
            continue
        ends = np.minimum(np.arange(last + 1) + group.size + group.edits, len(flat))
        likely = known[ends] - known[: last + 1] >= group.size - 1 - 2 * group.edits
        starts = np.flatnonzero(likely if group.edits else likely & inside[: last + 1])
        for walk in range(WALKS):
            if not len(starts):
                break
            found = _walk(flat, starts, group.size, index.pad, index.factors[walk], group.places[walk])
            for keys, (sorted_keys, pieces) in zip(found, group.keys[walk], strict=True):
                low = np.searchsorted(sorted_keys, keys, "left")
                high = np.searchsorted(sorted_keys, keys, "right")
                hits = np.flatnonzero(high > low)
                while len(hits):
                    out.append((starts[hits], pieces[low[hits]]))
                    low[hits] += 1
                    hits = hits[high[hits] > low[hits]]
    return out


def matches(texts: list[bytes], index: Index):
    """Yields ``(row, item name, edits, first word after the match)`` for every item found in every text."""
    if not index.items:
        return
    get, gap = index.ids.get, np.full(PIECE + 1, index.pad, np.int64)
    parts, rows, sizes, total = [], [], [], 0
    for row, text in enumerate([*texts, None]):
        if text is not None:
            ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
            parts += [ids, gap]
            rows.append(row)
            sizes.append(len(ids) + len(gap))
            total += sizes[-1]
        if rows and (text is None or total >= _POSITIONS):
            yield from _verify(np.concatenate(parts), np.array(rows), np.cumsum([0, *sizes]), index)
            parts, rows, sizes, total = [], [], [], 0


def _verify(flat: np.ndarray, rows: np.ndarray, bounds: np.ndarray, index: Index):
    found = _candidates(flat, index)
    if not found:
        return
    starts, pieces = (np.concatenate(c) for c in zip(*found, strict=True))
    owner = np.searchsorted(bounds, starts, "right") - 1
    # where the item would begin if nothing were added or taken out before the piece
    pairs = np.unique(np.stack([owner, index.item_of[pieces], starts - index.offset[pieces]]), axis=1)
    codes = _pair_codes(flat, index.pad)
    at, n = 0, pairs.shape[1]
    while at < n:
        doc, item, first = pairs[:, at].tolist()
        size, most = len(index.items[item]), index.edits[item]
        to, last = at + 1, first
        while to < n and pairs[0, to] == doc and pairs[1, to] == item and pairs[2, to] - last <= size:
            last = int(pairs[2, to])
            to += 1
        begin = max(int(bounds[doc]), first - 2 * most - 1)
        stop = max(begin, min(int(bounds[doc + 1]), last + size + 2 * most + 1))
        at = to
        # a match keeps all but two of the item's word pairs for each edit
        if sum(map(index.item_pairs[item].__contains__, codes[begin : max(begin, stop - 1)].tolist())) < size - 1 - 2 * most:
            continue
        score, end = best_edit(index.items[item], flat[begin:stop])
        if score <= most:
            yield int(rows[doc]), index.names[item], score, begin + end - int(bounds[doc])


def _blocks(benchmark: DataFrame, min_words: int):
    """Indexes over the whole item table, each of at most about ``BLOCK_ITEMS`` items."""
    items = text_bytes(benchmark, "item_id").where("item_id is not null")
    n = -(-items.count() // BLOCK_ITEMS)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield build([(r.item_id, bytes(r.text)) for r in sorted(block.distinct().collect(), key=lambda r: (r.item_id, bytes(r.text)))], min_words=min_words)


def find(docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """One row per benchmark item found in a row: ``doc_id, item_id, edits, end_word``.

    ``edits`` is the least word edit distance found, at most a fifth of the item's words; an item that
    occurs several times in a text is listed once, at its best place. Rows without a match give
    nothing. Null and empty texts and items match nothing, nor do items under ``min_words`` words or
    without an id; items under five words allow no edit. An item id with several texts stands for each.
    Repeated rows repeat their matches; of places with equally many edits the first counts; other
    columns are ignored; an empty table on either side gives no rows.
    """
    rows = text_bytes(docs, "doc_id")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, edits int, end_word long"
    out = None
    item_type = arrow_type(benchmark, "item_id")
    for index in _blocks(benchmark, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                best: dict = {}
                for row, item, edits, end in matches(batch.column(1).to_pylist(), shared.value):
                    best[row, item] = min(best.get((row, item), (edits, end)), (edits, end))
                at = pa.array([row for row, _ in best], pa.int64())
                columns = [batch.column(0).take(at), pa.array([i for _, i in best], item_type)]
                columns += [pa.array([e for e, _ in best.values()], pa.int32()), pa.array([e for _, e in best.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "end_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` in which :func:`find` finds no item, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[row for row, *_ in matches(texts, shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
