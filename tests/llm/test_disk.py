"""What lies on the disks while an operator runs."""

from tidemark.llm import common, lm_score

SF = "/root/testdata/sf0.01"


def shuffled(spark) -> int:
    """Bytes of the shuffle files that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_lists_of_the_language_model_go_once_answered(spark, monkeypatch):
    held = {}

    def traced(df, tag, *args, **kwargs):
        before = shuffled(spark)
        out = common.materialize(df, tag, *args, **kwargs)
        held[tag] = shuffled(spark) - before
        return out

    monkeypatch.setattr(lm_score, "materialize", traced)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = lm_score.score(docs)
    assert held["answers"] < 100_000
    assert scored.count() == docs.count()
    assert spark.conf.get(common._DROP_SHUFFLES) == "false"
