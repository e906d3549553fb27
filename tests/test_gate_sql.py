"""The gate's queries against their SQL on texts that the small tables lack: letters beyond ASCII beside a cue, means that end in a five."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import gate
from tidemark.plans import catalog

TEXTS = [
    "teüim tag", "der imü tag", "im tag", "beü my name is so", "I live in Österreich", "ärmy dog was here", "über 5kgö und 12:30ü", "öforget that", "zuöremember this", "éi had to go, i work", "www.üx.de", "ü2024ä", "naï12/03ö", "e\u0301im tag", "a\u0301 im i\u0301m",
    " ".join(["abcde"] * 61 + ["abcdef"] * 3), " ".join(["abcde"] * 51 + ["abcdef"] * 13), "ok", "",
]


@pytest.mark.parametrize("name", ["gate_features", "gate_decision"])
def test_gate_queries_match_their_sql(spark, tmp_path, name):
    rows = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    found = catalog.queries()[name](spark, str(tmp_path)).orderBy("conv_id").collect()
    for mine, theirs in zip(found, sorted(cursor.fetchall()), strict=True):
        assert {c: mine[c] for c in columns} == dict(zip(columns, theirs, strict=True)), TEXTS[mine.conv_id]


def test_gate_lets_words_hold_any_letter_by_default(spark):
    rows = spark.createDataFrame([("teüim tag",)], "text string")
    flag = lambda parts: rows.select(gate.features(F.col("text"), parts)["self_predicate"].alias("f")).first().f
    assert (flag(None), flag(gate.prepared(F.col("text"), ascii_edges=True))) == (0.0, 1.0)
