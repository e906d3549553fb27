"""Queries that SQL cannot express, against plain versions over whole small tables."""

import numpy as np
import pytest

from tidemark.functions import text as T
from tidemark.functions.encode import LexicalEncoder
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def turns(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    encoder = LexicalEncoder(64)
    found = sorted((r.conv_id * 1000 + r.turn, f"doc_{r.conv_id}_{r.turn}", r.text) for r in rows)
    return encoder, found, np.array([encoder.embed(t) for _, _, t in found], np.float64)


def ranked(encoder, found, vectors, query, k):
    q = np.asarray(query, np.float64)
    cosine = vectors @ (q / np.linalg.norm(q))
    order = sorted((-c, row, at) for at, ((row, _, _), c) in enumerate(zip(found, cosine, strict=True)) if c >= 0)[:k]
    return [(at, -c) for c, _, at in order]


def test_decomposed_search(spark, turns):
    encoder, found, vectors = turns
    parts = T.decompose_query("what is the thing, and how does it work?")
    assert len(parts) == 2
    hits = sorted((depth, -score, sub, at) for sub, part in enumerate(parts) for depth, (at, score) in enumerate(ranked(encoder, found, vectors, encoder.embed(part), 5)))
    want, texts = [], set()
    for _, _, _, at in hits:
        if found[at][2] not in texts:
            texts.add(found[at][2])
            want.append(found[at][2])
    got = [r.text for r in catalog.queries()["search_decomposed"](spark, SF).collect()]
    assert sorted(got) == sorted(want[:5])


def test_two_hop_search(spark, turns):
    encoder, found, vectors = turns
    question, k = "what is the thing", 4
    first = ranked(encoder, found, vectors, encoder.embed(question), k)
    second = ranked(encoder, found, vectors, encoder.embed(f"{question}\n{found[first[0][0]][2]}"), k + k // 2 + 2)
    chosen = {}
    for at, cosine in [*first[: -(-k // 2)], *second, *first[-(-k // 2) :]]:
        chosen.setdefault(found[at][1], cosine)
    want = sorted(list(chosen.items())[:k])
    got = sorted((r.doc_id, r.cosine) for r in catalog.queries()["search_multihop"](spark, SF).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [c for _, c in got] == pytest.approx([c for _, c in want], abs=1e-6)


def test_joined_chunks(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalog.queries()["join_chunks"](spark, SF).collect()}
    assert set(got) == set(texts) and sum(len(t.split()) > 500 for t in texts.values()) > 10
    whole = 0
    for i, text in texts.items():
        words, left = got[i].split(), iter(text.split())
        assert all(w in left for w in words)  # nothing is added or moved
        whole += words == text.split()
    assert whole / len(texts) > 0.9
