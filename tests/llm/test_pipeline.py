"""The pipeline's stages take effect, keep what they should and agree with running them one by one."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert all(i in after for i, t in before.items() if quality.get(i) == 1 and len(t.split()) >= 60)
        if name == "line_dedup":
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
        else:
            assert all(before[i] == t for i, t in after.items())
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in docs.collect()} <= ids
    whole = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.taken) for r in mixed}
