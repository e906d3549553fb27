"""Vectors, chains, maintenance, ranking and search on small constructed stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.encode import LexicalEncoder
from tidemark.operators import analytics, filters, maintain, ranking, revisions, search
from tidemark.operators import vectors as V
from tidemark.schema import FACTS, with_group_key


def toward(q, cosine, rng):
    """A unit vector at a given cosine to ``q``."""
    r = rng.normal(size=len(q))
    r -= (r @ q) * q
    return (cosine * q + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r)).tolist()


@pytest.fixture(scope="module")
def q():
    v = np.random.default_rng(0).normal(size=16)
    return v / np.linalg.norm(v)


def store(spark, rows):
    """Rows of ``(row_id, text, source, metadata, ts, revision, user, entity, declared, embedding)``."""
    full = [(r[0], f"doc_{r[0]}", *r[1:6], r[6], None, r[7], None, r[8], r[9]) for r in rows]
    return with_group_key(spark.createDataFrame(full, FACTS))


@pytest.fixture(scope="module")
def chain(spark, q):
    rng = np.random.default_rng(1)
    rows = [(i, f"my address is {n}", "chat", "{}", 1.7e9 + i * 86400, i + 1, "u", "location", True, toward(q, 0.80 - 0.015 * i, rng)) for i, n in enumerate("abcd")]
    rows += [(10, "unrelated note", "notes.txt:1-50", '{"filename": "notes.txt"}', 1.7e9, 1, "u", None, False, toward(q, 0.3, rng)), (11, "my address is z", "chat", "{}", 1.7e9, 1, "v", "location", True, toward(q, 0.5, rng))]
    return store(spark, rows)


def test_search_direction_and_labels(chain, q):
    def first(question, **o):
        return search.search(chain.where("user_id = 'u'"), question, q, 3, **o).collect()[0]

    now, before, oldest = first("what is my address?"), first("what was my address just before this one?"), first("what was my original address?")
    assert (now.text, before.text, oldest.text) == ("my address is d", "my address is c", "my address is a")
    assert now.superseded is False and now.superseded_at is None and before.superseded is True and before.superseded_at == pytest.approx(1.7e9 + 3 * 86400)
    assert first("anything", direction="previous").text == "my address is c" and first("what was my original address?", direction="latest").text == "my address is d"
    past = first("what is my address?", as_of=1.7e9 + 90000)
    assert past.text == "my address is b" and past.superseded is True


def test_boosts_are_bounded(chain, q):
    for question in ("what is my address?", "what was my original address?", "unrelated"):
        for r in search.search(chain, question, q, 10).collect():
            assert -1e-9 <= r.score - r.cosine <= ranking.MAX_BOOST + 1e-9
    plain = search.search(chain.where("entity IS NULL"), "what is my address?", q, 5).collect()
    assert all(r.score == r.cosine and r.superseded is None for r in plain)


def test_search_guards(chain, q):
    assert search.search(chain, "x", q, 0).collect() == [] and search.search(chain, "x", np.zeros(16), 3).collect() == []
    with pytest.raises(ValueError):
        V.checked_query([1.0, 2.0], 16)
    assert search.summary(chain, q, 2, 0.6) == {"top_k": 2, "floor": 0.6, "n_above_floor": 4, "returned": 2, "truncated": True}
    assert "raise top_k" in search.explain(search.summary(chain, q, 2, 0.6)) and search.search(chain, "x", q, 9, where={"filename": "notes.txt"}).count() == 1


def test_history_keeps_one_group(chain, q):
    got = search.history(chain, "what has my address been?", q).collect()
    assert [r.text[-1] for r in got] == list("abcd") and [r.superseded for r in got] == [True, True, True, False]
    assert [r.text[-1] for r in search.history(chain, "what has my address been?", q, 2).collect()] == ["c", "d"] and search.history(chain, "x", q, 0).count() == 0


def test_backfilled_chain_follows_time(spark, q):
    rng = np.random.default_rng(2)
    facts = store(spark, [(i, f"v{i}", "chat", "{}", ts, i + 1, "u", "location", True, toward(q, 0.7, rng)) for i, ts in enumerate((300.0, 200.0, 100.0))])
    assert revisions.member(facts, "current").first().text == "v0" and [r.text for r in revisions.history(facts).orderBy("position").collect()] == ["v2", "v1", "v0"]
    assert {r.text: r.superseded for r in revisions.supersession(facts).collect()} == {"v0": True, "v1": True, "v2": False}
    assert {r.text: r.superseded for r in revisions.supersession(facts, "time").collect()} == {"v0": False, "v1": True, "v2": True}
    assert revisions.concordance(facts).first().concordant is False


def test_equal_pairs_share_their_successor(spark, q):
    facts = store(spark, [(0, "a", "chat", "{}", 1.0, 1, "u", "x", False, q.tolist()), (1, "b", "chat", "{}", 1.0, 1, "u", "x", False, q.tolist()), (2, "c", "chat", "{}", 5.0, 2, "u", "x", False, q.tolist())])
    assert {r.text: r.superseded_at for r in revisions.supersession(facts).collect()} == {"a": 5.0, "b": 5.0, "c": None}


def test_ties_go_to_the_lower_row(spark, q):
    facts = spark.createDataFrame([(5, q.tolist()), (3, q.tolist()), (4, (-q).tolist())], "row_id long, embedding array<float>")
    assert [r.row_id for r in V.top_k(V.scored(facts, q.tolist()), "cosine", 2).collect()] == [3, 5]
    assert [(r.row_id, r["rank"]) for r in V.batch_top_k(facts, [(7, q.tolist())], 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]
    assert V.legacy_inverse(0.6 * 0.5 + 0.4 * 0.5**13) == pytest.approx(0.5)


def test_screen_is_exact_at_every_width(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 12)) @ np.diag(np.linspace(3, 0.1, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    facts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<float>")
    query = x[17].tolist()
    want = [r.row_id for r in V.top_k(V.scored(facts, query), "cosine", 5).collect()]
    for width in (1, 6, 12):
        basis = V.screen_basis(facts, width)
        assert [r.row_id for r in V.screened_top_k(V.with_screen(facts, basis), query, basis, 5, seed_rows=8).collect()] == want
    assert [r.row_id for r in V.late_top_k(facts, query, 5, "row_id").orderBy(F.col("cosine").desc()).collect()] == want


def test_filters(spark):
    metas = ['{"k": 1, "t": true, "l": [1, "a"], "n": null, "f": 1.5, "s": "x"}', '{"k": "1", "t": "True", "l": "a"}', "{}", None, "not json"]
    rows = spark.createDataFrame(list(enumerate(metas)), "id int, metadata string")

    def ids(**where):
        return {r.id for r in rows.where(filters.matches(F.col("metadata"), where)).collect()}

    assert ids(k=1) == {0, 1} and ids(k="1") == {0, 1} and ids(t=True) == {0, 1} and ids(l="a") == {0, 1} and ids(l=1) == {0} and ids(n=None) == {0} and ids(f=1.5) == {0} and ids(k=[1, 2]) == {0, 1} and ids(k=1, s="x") == {0} and ids(missing=1) == set() and ids(l=["a"]) == {1}
    strict = {r.id for r in rows.where(filters.matches_strictly(F.col("metadata"), {"k": 1})).collect()}
    assert strict == {0}
    for bad in ("", "  ", {}):
        with pytest.raises(ValueError):
            filters.check_criterion("where", bad)
    with pytest.raises(ValueError):
        filters.check_reserved({"parent_id": "x"})


def test_delete_and_split(chain):
    ids = lambda df: {r.row_id for r in df.collect()}
    assert ids(maintain.delete(chain, source="notes.txt")) == {0, 1, 2, 3, 11} and ids(maintain.delete(chain, text_contains="ADDRESS", ids=["doc_0", "doc_10"])) == {1, 2, 3, 10, 11}
    assert ids(maintain.delete(chain)) == {0, 1, 2, 3, 10, 11} and ids(maintain.delete(chain, text_exact=" my address is a ")) == {1, 2, 3, 10, 11}
    with pytest.raises(ValueError):
        maintain.delete(chain, where={})
    assert maintain.file_name("A b/c") == "A_b_c" and maintain.file_name("Work", {"work"}) != "Work"
    match, rest = maintain.unmerge(chain.withColumn("project", F.when(F.col("row_id") < 2, "p")), "p")
    assert ids(match) == {0, 1} and ids(rest) == {2, 3, 10, 11}


def test_retention_counts_documents_not_chunks(spark, q):
    def meta(parent):
        return f'{{"parent_id": "{parent}"}}'

    rows = [(0, "old 1", "s", meta("d1"), 1.0, 1, "u", "x", True, None), (1, "old 2", "s", meta("d1"), 1.0, 2, "u", "x", True, None), (2, "new 1", "s", meta("d2"), 9.0, 3, "u", "x", True, None), (3, "new 2", "s", meta("d2"), 9.0, 4, "u", "x", True, None), (4, "alone", "s", "{}", 1.0, 1, "u", "y", True, None)]
    facts = store(spark, rows)
    assert {r.row_id for r in maintain.forget_superseded(facts).collect()} == {0, 1} and maintain.forget_superseded(facts, older_than=0.5).count() == 0
    assert {r.row_id for r in maintain.protected(facts).collect()} == {2, 3, 4}
    assert {r.n_revisions for r in analytics.volatility(facts, 10.0).collect()} == {4}
    assert {r.row_id for r in maintain.prune(facts, 86400.0 * 3, 1).collect()} == {0, 1}
    assert maintain.get(facts, "d2").first().text == "new 1 new 2"


def test_merge_reconciles_in_order(spark, q):
    have = store(spark, [(0, "a", "s", "{}", 10.0, 1, "u", "x", True, None), (1, "b", "s", "{}", 20.0, 2, "u", "x", True, None)])
    come = store(spark, [(0, "c", "s", "{}", 30.0, 1, "u", "x", True, None), (1, "d", "s", "{}", 5.0, 1, "u", "x", True, None), (2, "e", "s", "{}", 40.0, 1, "u", "x", True, None), (3, " B ", "s", "{}", 50.0, 9, "u", "x", True, None), (4, "f", "s", "{}", 1.0, 7, "u", None, False, None)])
    got = {r.text: (r.row_id, r.revision) for r in maintain.merge(have, come, "other", deduplicate=True).collect()}
    assert got == {"c": (2, 3), "d": (3, 1), "e": (4, 4), "f": (6, 7)}


def test_staleness_shrinks_to_the_pool(spark):
    facts = store(spark, [(i, "t", "s", "{}", ts, i, u, "x", True, None) for i, (u, ts) in enumerate([("a", 0.0), ("a", 10.0), ("b", 0.0), ("b", 30.0), ("b", 60.0)])])
    got = {r.group_key[0]: r for r in analytics.staleness(facts, 100.0, assume_memoryless=True).collect()}
    pool = 3 / 70
    assert got["a"].rate == pytest.approx((1 / 10 + pool) / 2) and got["b"].rate == pytest.approx((2 / 30 + pool) / 3) and (got["a"].confidence, got["b"].confidence) == ("prior", "weak")
    assert got["a"].p_superseded == pytest.approx(1 - np.exp(-got["a"].rate * 90)) and analytics.staleness(facts, 100.0).first().p_superseded is None
    with pytest.raises(ValueError):
        analytics.changes(facts, 5.0, 1.0)


def test_decomposed_and_two_hops(spark):
    enc = LexicalEncoder(64)
    texts = ["the gate code is four", "the wharf opens at nine", "boats leave from the wharf", "nothing else"]
    facts = store(spark, [(i, t, "doc", "{}", float(i), 1, None, None, False, enc.embed(t).tolist()) for i, t in enumerate(texts)])
    got = [r.text for r in search.search_decomposed(facts, "what is the gate code, and when does the wharf open?", enc, 2).collect()]
    assert set(got) == {texts[0], texts[1]} and len(search.clauses("a; " * 9)) <= 1
    hops = search.multihop(facts, "what leaves from the wharf", enc, 3).collect()
    assert {r.hop for r in hops} <= {1, 2} and len({r.doc_id for r in hops}) == 3
