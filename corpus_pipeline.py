"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, mixing, quality_rules, shingles
from tidemark.llm.common import WORD_RE, clear_scratch, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the line labels keep; the labeller learns from labelled rows of this input."""
    return quality_rules.filter_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` follows the text. A document goes if it lost lines and no word is left."""
    done = line_dedup.dedup(docs)
    left = done.where((F.col("n_exact") + F.col("n_near") == 0) | F.col("text").rlike(f"(?s){WORD_RE}"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHashes at most two bits apart, or five-word shingles at Jaccard 0.8 or more; the one with the least id."""
    return shingles.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's size, its source's target and how often it is taken."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixture)]

#: The stages fit models and follow links, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage wrote for itself is deleted once its result is stored; the last stage's stays for the result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            clear_scratch(spark, keep_last=1)
    return docs
