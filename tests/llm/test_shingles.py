"""The pipeline's near-duplicate stage against brute force over planted near copies."""

import random
from fractions import Fraction

import corpus_pipeline
from tidemark.llm import shingles

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(docs):
    ids, sets, root = sorted(docs), {i: plain_set(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and len(x & y) * 5 >= 4 * len(x | y)):
                if docs[a] != docs[b]:
                    pairs.append((a, b))
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in ids if find(i) == i}, pairs


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary, docs = [f"w{k}" for k in range(2000)], {}
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([4, 20, 60, 150, 400]))
        docs[len(docs)] = " ".join(base)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs[len(docs)] = " ".join(copy)
    return docs | {len(docs): "", len(docs) + 1: " "}


def stage_kept(spark, docs):
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()}


def test_stage_finds_planted_near_copies(spark):
    docs = planted()
    want, pairs = plain_kept(docs)
    assert len(pairs) > 50 and stage_kept(spark, docs) == want


def test_stage_finds_the_near_copies_of_the_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, pairs = plain_kept(docs)
    assert pairs and stage_kept(spark, docs) == want


def test_similar_is_exact_at_the_limit():
    a, b = shingles.np.arange(9, dtype="u8"), shingles.np.arange(1, 10, dtype="u8")
    assert shingles.similar(a, b, Fraction(4, 5)) and not shingles.similar(a[:8], b[:8], Fraction(4, 5))
