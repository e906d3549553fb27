"""Column functions against plain Python, the chunker and its inverse, the gate, the encoder."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed as K
from tidemark.functions import gate
from tidemark.functions import text as T
from tidemark.functions.encode import LexicalEncoder, embed_column

TEXTS = ["", "  padded\t", "My blood type is O negative", "haha that is brilliant", "日本語のテキストです", "an emoji 🙂 in text", "What is my original number?", "please remember that I like tea", "I'm 42 and paid $30 on 2024-05-06 at 3pm", "a b", None]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def column(rows, value):
    return [r.v for r in rows.select("id", value.alias("v")).orderBy("id").collect()]


def test_fingerprint_and_id(rows):
    text = F.col("text")
    assert column(rows, T.doc_fingerprint(text)) == [None if t is None else hashlib.sha256(t.strip().encode()).hexdigest() for t in TEXTS]
    assert column(rows, T.doc_id(text)) == [None if t is None else "doc_" + hashlib.md5(t.encode()).hexdigest()[:10] for t in TEXTS]
    assert column(rows, T.word_count(text)) == [None if t is None else len(t.split()) for t in TEXTS]


def test_dense(rows):
    assert column(rows, F.coalesce(T.is_dense(F.col("text")), F.lit(False))) == [T.dense(t or "") for t in TEXTS]


def test_directions_and_cues(rows):
    from tidemark.functions import attributes as A

    assert column(rows, T.query_direction(F.coalesce("text", F.lit("")))) == [A.query_direction(t) for t in TEXTS]
    assert column(rows, T.temporal_cue(F.col("text"))) == [A.has_temporal_cue(t) for t in TEXTS]
    shown = column(rows, T.structural_class(F.coalesce("text", F.lit(""))))
    assert shown == [A._shape(t or "", (t or "").lower()) for t in TEXTS]


def test_chunks_rejoin():
    paragraphs = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(90)) + "." for i in range(14))
    chunks = T.split_large_text(paragraphs)
    assert len(chunks) > 2 and all(len(c.split()) <= K.MAX_WORDS + K.OVERLAP_WORDS for c in chunks)
    assert T.join_chunks(chunks) == " ".join(paragraphs.split())
    assert T.split_large_text("  ") == [] and T.split_large_text(" one ") == ["one"]
    one_line = " ".join(f"x{k}" for k in range(1300))
    assert [len(c.split()) for c in T.split_large_text(one_line)] == [500, 540, 340]
    dense = "語" * 4000
    assert all(len(c) <= 1500 + 122 for c in T.split_large_text(dense)) and len(T.split_large_text(dense)) == 3


def test_line_windows(spark):
    text = "\n".join(f"line {k}" for k in range(95)) + "\n"
    got = spark.createDataFrame([(text,)], "text string").select(F.inline(T.line_windows(F.col("text")))).collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 50), (41, 90), (81, 95)] and got[1].text.split("\n")[0] == "line 40"
    assert [len(r) for r in T.split_lines_by_words(["a b c"] * 5, 7)] == [2, 2, 1]


def test_decompose():
    assert T.decompose_query("What is BPE, and how does KV caching work?") == ["What is BPE", "how does KV caching work"]
    assert T.decompose_query("What is BPE, KV cache, and LoRA?") == ["What is BPE", "What is KV cache", "What is LoRA"]
    assert T.decompose_query("one question only") == ["one question only"] and T.decompose_query("") == []


def test_labels_and_times(spark):
    row = spark.range(1).select(
        T.staleness_label(F.lit(True), F.lit(0.0), F.lit(86400.0 * 3)).alias("a"), T.staleness_label(F.lit(False), F.lit(None).cast("double"), F.lit(1.0)).alias("b"), T.staleness_label(F.lit(True), F.lit(0.0), F.lit(86400.0 * 900)).alias("c"),
        T.parse_time(F.lit("12.5")).alias("d"), T.parse_time(F.lit("2024-01-02")).alias("e"), T.parse_time(F.lit("nonsense")).alias("f"), T.format_time(F.lit(1704153600.0)).alias("g"), T.format_span(F.lit(7200.0)).alias("h"),
    ).first()
    assert row.a.startswith("SUPERSEDED - replaced 3 days ago") and row.b == "" and "2.5 years ago" in row.c
    assert (row.d, row.e, row.f, row.g, row.h) == (12.5, 1704153600.0, None, "2024-01-02 00:00", "2h")


def test_gate(spark):
    said = [("My blood type is O negative, in case it ever matters.", True), ("haha that is brilliant", False), ("remember that the key is under the mat", True), ("forget that", False), ("ok", False), ("?!", False), ("I live in a small town by the sea", True), ("can you write me a poem please", False)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "id int, text string")
    got = gate.decide(rows).orderBy("id").collect()
    assert [r.should_store for r in got] == [w for _, w in said]
    values = rows.where("id = 0").select(*[c.alias(n) for n, c in gate.features(F.col("text")).items()]).first()
    text = said[0][0]
    assert values.log_chars == pytest.approx(math.log1p(len(text)) / 5) and values.possessive_my_ratio == pytest.approx(1 / 11) and values.proper_noun_ratio == 0


def test_lexical_encoder(spark):
    enc = LexicalEncoder(32)
    v = enc.embed("My dog is black")
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-5) and np.allclose(v, enc.embed("my DOG is black ")) and enc.embed("").sum() == 0
    h = int.from_bytes(hashlib.md5(b"ab").digest()[:4], "little")
    plain = np.sin(np.arange(32) * (h % 1000 + 1) * 0.01)
    assert np.allclose(enc.embed("ab"), plain / np.linalg.norm(plain), atol=1e-5)
    got = spark.createDataFrame([("My dog is black",)], "t string").select(embed_column(F.col("t"), enc)).first()[0]
    assert np.allclose(got, v)
