"""What line dedup shuffles, keeps on the disks and computes: each key once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_disk import SF, shuffled
from tidemark.llm import common, line_dedup, shingles


def test_shuffles_of_line_dedup_go_once_written(spark, monkeypatch):
    held = {}

    def traced(df, tag, *args, **kwargs):
        before = shuffled(spark)
        out = common.materialize(df, tag, *args, **kwargs)
        held[tag] = shuffled(spark) - before
        return out

    monkeypatch.setattr(line_dedup, "materialize", traced)
    monkeypatch.setattr(shingles, "materialize", traced)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = line_dedup.dedup(docs)
    assert {"classes", "shared", "met_long", "lines", "met", "long", "near"} <= set(held)
    assert max(held.values()) < 10_000, held
    assert done.count() == docs.count()
    assert spark.conf.get(common._DROP_SHUFFLES) == "false"


@pytest.mark.parametrize("more", [[], ["whole"]])
def test_shared_keys_are_dealt_out_once(spark, tmp_path, more):
    rows = [(k % 5 if k < 40 else k, k % 11, k % 2 == 0) for k in range(60)]
    spark.createDataFrame(rows, "key long, h long, whole boolean").write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows").select("key", "h", *more)
    found = line_dedup._several(table)
    # joined by hash afterwards, as in the operator, so that tests for null are pushed down
    joined = found.join(table.groupBy("h").agg(F.count("*").alias("n")), "h")
    owners = {key: {h for k, h, _ in rows if k == key} for key, _, _ in rows}
    want = sorted(x[: 2 + len(more)] for x in rows if len(owners[x[0]]) > 1)
    assert sorted(tuple(r)[: 2 + len(more)] for r in joined.select(*table.columns).collect()) == want
    frame = joined.select(*table.columns)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") >= 1


def test_three_half_keys_a_line():
    rng = random.Random(3)
    for n in range(2, 96):
        a = [b"%d" % rng.randrange(9) for _ in range(n)]
        assert len(line_dedup.half_keys(a)) == 3
        for k in range(n):
            for b in (a[:k] + a[k + 1 :], [*a[:k], b"x", *a[k + 1 :]], [*a[:k], b"y", *a[k:]]):
                assert len(b) < 2 or set(line_dedup.half_keys(a)) & set(line_dedup.half_keys(b))


def test_shared_values_equal_counts_of_common_values(monkeypatch):
    monkeypatch.setattr(shingles, "_COLUMNS", 7)
    monkeypatch.setattr(shingles, "_CELLS", 50)
    rng = np.random.default_rng(5)
    some = lambda n, kind: [np.unique(rng.integers(0, 90, rng.integers(0, 60))).astype(kind) for _ in range(n)]
    for kind in (np.uint64, np.int64):
        for asked, others in ((some(9, kind), some(23, kind)), (some(3, kind), []), ([], some(3, kind)), ([np.empty(0, kind)], some(2, kind))):
            want = [[len(np.intersect1d(x, y)) for x in asked] for y in others]
            assert shingles.shared_values(asked, others).tolist() == want
