"""A question that names the store's owner, in a store with more name texts than any cap."""

from test_operators import store

from tidemark.operators import ranking


def test_every_owner_is_known(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"zo{letters[k // 26 // 26]}{letters[k // 26 % 26]}{letters[k % 26]}" for k in range(1500)]
    vector = [1.0] + [0.0] * 15
    facts = store(spark, [(k, f"my name is {n}", "chat", "{}", 1.7e9, 1, f"u{k}", "name", False, vector) for k, n in enumerate(names)])
    known = ranking.owner_names(facts, " ".join(names))
    assert known == set(names)
    assert all(ranking.owner_names(facts, f"what is {names[k]} allergic to?") == {names[k]} for k in (0, 1499))
    assert ranking.owner_names(facts, "what is nobody allergic to?") == frozenset() == ranking.owner_names(facts, "?")
