"""The API end to end on small stores."""

import pytest

from tidemark.functions.encode import LexicalEncoder
from tidemark.vault import Vault


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    v = Vault(spark, f"file://{tmp_path_factory.mktemp('v')}/main", LexicalEncoder(64))
    v.add("my phone number is 555-0100-200", "chat", {"team": "a"}, 1_700_000_000.0, "u")
    v.add("my phone number is now 555-0100-300", "chat", {"team": "b"}, 1_700_086_400.0, "u")
    v.add("the harbour closes at nine", "notes", None, 1_700_000_500.0)
    return v


def test_reads(vault):
    assert vault.add("   ") == "" and vault.store.count() == 3
    rows = {r.text[-3:]: r for r in vault.get_all_records().collect()}
    assert rows["300"].revision == 2 and rows["200"].entity == rows["300"].entity == "phone_number" and rows["ine"].entity is None
    best = vault.search("what is my phone number?", 2).collect()
    assert best[0].text.endswith("300") and best[0].superseded is False and best[1].superseded is True
    assert vault.search("what was my original phone number?", 1).first().text.endswith("200")
    assert [r.text[-3:] for r in vault.history("what is my phone number?").collect()] == ["200", "300"]
    assert [r.text[-3:] for r in vault.changes(1_700_000_000.0).collect()] == ["ine", "300"]
    assert vault.volatility(now=1_700_200_000.0).first().intervals == [86400.0] and vault.staleness(now=1_700_200_000.0).count() == 1
    assert vault.exists(rows["ine"].doc_id) and vault.get(rows["ine"].doc_id).first().text.startswith("the harbour")
    assert "SUPERSEDED" in vault.context("what is my phone number?") and vault.stats().first().n_groups == 1
    assert vault.should_store("My blood type is O negative") and not vault.should_store("ok")
    assert {r.key for r in vault.inspect()[1].collect()} == {"team"} and vault.search_batch([vault.embedder.embed("harbour"), [0.0] * 64], 1).count() == 1
    with pytest.raises(ValueError):
        vault.add("x", metadata={"parent_id": "y"})


def test_long_texts_are_documents(spark, tmp_path):
    v = Vault(spark, f"file://{tmp_path}/long", LexicalEncoder(16))
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(120)) + "." for i in range(10))
    name = v.add(text, "book", timestamp=1.0)
    assert v.store.count() > 1 and v.get(name).first().text == " ".join(text.split()) and v.delete(text_exact=text) > 1 and v.store.count() == 0


def test_writes(spark, tmp_path):
    a, b = (Vault(spark, f"file://{tmp_path}/{n}", LexicalEncoder(32)) for n in "ab")
    for k, t in enumerate(("my pet is a dog", "my pet is a cat")):
        a.add(t, "chat", {"k": str(k)}, float(k + 1), "u")
        b.add(t.replace("cat", "CAT") if k else t + "!", "chat", {"k": "9"}, float(k + 5), "u")
    first = a.get_all_records().first().doc_id
    a.update(first, text="my pet is a parrot", metadata={"k": "7"})
    changed = a.get_all_records({"k": 7}).first()
    assert changed.text.endswith("parrot") and changed.revision == 2 and changed.ts == 1.0
    assert a.merge(b, deduplicate=True)["added"] == 1 and a.unmerge(b.store.path) == 1 and a.store.count() == 2
    assert a.split_by_key("k", f"file://{tmp_path}/parts") == {"7": 1, "1": 1}
    assert a.search_multi([b], "pet", 3).count() == 3 and a.export(b, where={"k": "1"}) == 1
    a.compact(2)
    assert a.forget("my pet is a parrot", 1, 0.9) == 1 and a.prune(now=1e9, max_age_days=1, protect=False) > 0 and a.store.count() == 0
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "x.py").write_text("print(1)\n")
    assert a.ingest_directory(f"file://{tmp_path}/code") == 1 and a.ingest_directory(f"file://{tmp_path}/code") == 1


def test_commands(spark, tmp_path):
    from tidemark.__main__ import run

    path = f"file://{tmp_path}/cli"
    assert run(spark, [path, "add", "my pet is a dog", "--user", "u", "--time", "2024-01-01"]).startswith("doc_")
    run(spark, [path, "add", "my pet is a cat", "--user", "u", "--time", "1704240000"])
    assert run(spark, [path, "search", "what is my pet?", "--top-k", "1"]).first().text.endswith("cat")
    assert run(spark, [path, "search", "what is my pet?", "--top-k", "1", "--as-of", "2024-01-02"]).first().text.endswith("dog")
    assert run(spark, [path, "changes", "2024-01-01"]).count() == 1 and run(spark, [path, "history", "what is my pet?"]).count() == 2 and run(spark, [path, "stats"]).first().n_rows == 2
    with pytest.raises(SystemExit):
        run(spark, [path, "changes", "not a time"])
