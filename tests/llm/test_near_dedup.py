"""The pipeline's near-duplicate stage follows SimHash balls and shingle similarity, each where the other stops."""

import random

import corpus_pipeline
from tidemark.llm import shingles, simhash

SF = "/root/testdata/sf0.01"


def near(a, b):
    """(SimHashes at most two bits apart, five-word shingles at 0.8 or more)"""
    x, y = (set(shingles.shingles(t.encode()).tolist()) for t in (a, b))
    bits = (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    return bits <= 2, 5 * len(x & y) >= 4 * len(x | y)


def edited(words, n, rng):
    copy = list(words)
    for at in rng.sample(range(5, len(copy) - 5), n):
        copy[at] = f"x{rng.randrange(10**6)}"
    return copy


def chain():
    """Texts a, b, c: a and b are linked by their SimHashes only, b and c by their shingles only, a and c not at all."""
    rng = random.Random(5)
    while True:
        base = rng.choices([f"w{k}" for k in range(2000)], k=300)
        other = edited(base, 9, rng)
        a, b = " ".join(base), " ".join(other)
        if near(a, b) != (True, False):
            continue
        for _ in range(50):
            c = " ".join(edited(other, 5, rng))
            if near(b, c) == (False, True) and near(a, c) == (False, False):
                return a, b, c


def kept(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()}


def test_stage_follows_both_kinds_of_links(spark):
    a, b, c = chain()
    alone = "another text of a few words that nothing else is near to"
    assert kept(spark, a, b, alone) == {1, 3}
    assert kept(spark, a, b, c, alone, alone) == {1, 4}
    assert kept(spark, c, a, alone, b) == {1, 3}
    assert kept(spark, a, c) == {1, 2}
