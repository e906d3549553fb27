"""The store's snapshots, file ingest and live ingest."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.schema import FACTS, with_group_key
from tidemark.sources.files import file_chunks, read_directory
from tidemark.sources.store import FactStore, StoreClosed, profile_path
from tidemark.streaming import ingest


def facts(spark, rows):
    return with_group_key(spark.createDataFrame([(i, f"doc_{i}", t, "chat", "{}", float(i), i + 1, "u", None, "x", None, True, [1.0]) for i, t in rows], FACTS))


def test_store_round_trip(spark, tmp_path):
    store, other = FactStore(spark, f"file://{tmp_path}/a"), FactStore(spark, f"file://{tmp_path}/b")
    assert store.count() == 0
    store.append(facts(spark, [(0, "a"), (1, "b")]))
    store.append(facts(spark, [(2, "c")]))
    before = store.facts()
    assert store.count() == 3 and store.exists("doc_1") and not store.exists("nope")
    assert store.delete(text_contains="b") == 1 and store.count() == 2 and before.count() == 3
    assert {r.row_id for r in store.forget_superseded(dry_run=True).collect()} == {0} and store.count() == 2
    assert store.export(other, source_doc="chat") == 2 and other.count() == 2
    assert store.merge(facts(spark, [(0, "A "), (1, "new")]), "b", deduplicate=True) == {"incoming": 2, "added": 1, "duplicates_skipped": 1}
    store.forget_superseded()
    assert store.count() == 1
    store.compact(1)
    assert store.count() == 1
    store.close()
    with pytest.raises(StoreClosed):
        store.append(facts(spark, [(9, "z")]))
    assert profile_path("/r/", "Ann B") == "/r/Ann_B"


def test_directory_ingest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.py").write_text("\n".join(f"    line {k}" for k in range(60)))
    (tmp_path / ".git" / "c.py").write_text("hidden")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "nul.txt").write_bytes(b"a\0b")
    files = read_directory(spark, f"file://{tmp_path}")
    assert [r.base for r in files.collect()] == ["a.py"]
    chunks = file_chunks(files, metadata=lambda text, a, b: {"lines": b - a + 1}).orderBy("start_line").collect()
    assert [(c.start_line, c.end_line, c.source) for c in chunks] == [(1, 50, "a.py:1-50"), (41, 60, "a.py:41-60")] and chunks[0].text.startswith("    line 0") and '"lines":"50"' in chunks[0].metadata
    assert chunks[0].doc_id.startswith("a.py@") and chunks[0].doc_id.endswith(":1-50")


SAID = [(0, "my phone is 1", "chat", "u"), (1, "it is now 2", "chat", "u"), (2, "the sea", "chat", "u"), (3, "my phone is 9", "chat", "v"), (4, "my phone is 3", "book", "u"), (5, "my phone is 4", "chat", "u")]
WANT = {0: ("phone_number", 1), 1: ("phone_number", 2), 2: (None, 1), 3: ("phone_number", 1), 4: (None, 1), 5: ("phone_number", 3)}
COLUMNS = "row_id long, doc_id string, text string, source string, metadata string, ts double, user_id string, project string, entity string"


def raw(spark, rows):
    return spark.createDataFrame([(i, f"d{i}", t, s, "{}", float(i), u, None, None) for i, t, s, u in rows], COLUMNS)


def test_batch_ingest(spark):
    assert {r.row_id: (r.entity, r.revision) for r in ingest.ingest_batch(raw(spark, SAID)).collect()} == WANT


def test_stream_ingest_keeps_state_between_batches(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    for k in range(0, 6, 2):
        raw(spark, SAID[k : k + 2]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.ingest_stream(stream).writeStream.format("memory").queryName("ingested").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.row_id: (r.entity, r.revision) for r in spark.sql("SELECT * FROM ingested").collect()}
    assert got == WANT


def test_tagging_keeps_what_is_declared():
    rows = pd.DataFrame({"text": ["x", "it is y"], "source": ["chat", "chat"], "entity": ["My Pet", None], "row_id": [0, 1]})
    done, last = ingest.tag(rows, None)
    assert list(done.entity) == ["my_pet", "my_pet"] and list(done.declared) == [True, False] and last == "my_pet"


def test_store_stream_reads_appends(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/s")
    store.append(facts(spark, [(0, "a")]))
    query = store.stream().groupBy("group_key").agg(F.count("*").alias("n")).writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT sum(n) AS n FROM seen").first().n == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/two"
    one, two = FactStore(spark, path), FactStore(spark, path)
    one.append(facts(spark, [(k, f"t{k}") for k in range(6)]))
    turns = []

    def slow(rows):  # while this rewrite runs, another writer rewrites and appends
        if not turns:
            turns.append(1)
            two.append(facts(spark, [(10, "late")]))
            two.rewrite(lambda f: f.where("row_id <> 1"))
            two.append(facts(spark, [(11, "later")]))
        return rows.where("row_id <> 2")

    one.rewrite(slow)
    assert {r.row_id for r in one.facts().collect()} == {0, 3, 4, 5, 10, 11} == {r.row_id for r in two.facts().collect()}


def test_appends_during_a_rewrite_are_carried(spark, tmp_path):
    path = f"file://{tmp_path}/carry"
    store, other = FactStore(spark, path), FactStore(spark, path)
    store.append(facts(spark, [(0, "a"), (1, "b")]))
    seen = store.state()

    def change(rows):
        other.append(facts(spark, [(7, "between")]))
        return rows.where("row_id = 0")

    store.rewrite(change)
    assert sorted(r.row_id for r in store.facts().collect()) == [0, 7]
    assert store.reload(seen)[0] == "replaced"
    # an appender that began before the pointer moved carries its part itself
    number, snapshot = store._head()
    claim, heads = other._head, iter([(number, snapshot)])
    other._head = lambda: next(heads, None) or claim()
    store.rewrite(lambda f: f)
    other.append(facts(spark, [(9, "old view")]))
    assert sorted(r.row_id for r in store.facts().collect()) == [0, 7, 9]


def test_reload_tells_what_is_new(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/reload")
    store.append(facts(spark, [(0, "a")]))
    seen = store.state()
    assert store.reload(seen)[0] == "same"
    store.append(facts(spark, [(1, "b")]))
    kind, rows = store.reload(seen)
    assert kind == "appended" and [r.row_id for r in rows.collect()] == [1]


def test_held_rows_are_seen_and_flushed(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/held")
    store.append(facts(spark, [(0, "a")]))
    store.hold(facts(spark, [(1, "b")]))
    assert store.count() == 2 and store.facts(pending=False).count() == 1 and FactStore(spark, store.path).count() == 1
    store.flush()
    assert store.facts(pending=False).count() == 2 == FactStore(spark, store.path).count()


def test_batch_equals_the_fold(spark):
    said = ["my phone is 1", "it is now 2", "his is 5", "that was mine", "the sea", "my sister's phone is 3", "it changed to 4", "mine is 9", "she moved", "it is red", "my car is a van", None]
    rng = __import__("random").Random(2)
    rows = [(k, f"d{k}", rng.choice(said), rng.choice(["chat", "chat", "book"]), "{}", float(k), rng.choice(["u", "v", None]), None, rng.choice([None] * 8 + ["My Pet"])) for k in range(300)]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    want = {}
    for user in ("u", "v", None):
        part = frame[frame.user_id.isna() if user is None else frame.user_id == user]
        done, _ = ingest.tag(part, None)
        want |= {r.row_id: (r.entity if isinstance(r.entity, str) else None, r.declared) for r in done.itertuples()}
    got = {r.row_id: (r.entity, r.declared) for r in ingest.ingest_batch(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want and sum(e is not None for e, _ in want.values()) > 50
