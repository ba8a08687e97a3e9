"""The corpus pipeline: rules, quality classifier, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  In all of them a
null text counts as empty; null and repeated ids keep a row each but where a stage says otherwise; very
long texts are read whole; columns beside ``doc_id`` and ``text`` pass through the first four stages
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.llm import decontaminate, mixing, ordinal, quality_rules, simhash
from isospark.llm.common import free_name, scratch_path
from isospark.llm.queries import TARGETS, domain_labels


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail no rule of the default policy; null and empty texts fail.  Rows are judged one by one, so there are no ties."""
    return quality_rules.keep_passing(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose top grade is likely, by a model fitted to the rated rows that are left.

    A probability of exactly the threshold is kept; a text without words is judged by the thresholds
    alone; of repeated rows with a rated id one is fitted to, and all are judged.
    """
    return ordinal.keep_good(docs, ordinal.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id.

    Of repeated rows with that id one stays, whichever; rows with a null id all stay; texts without
    words are copies of each other.
    """
    return simhash.keep_one_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, benchmark passages cut out of the text; rows of which nothing is left, or that had none, go."""
    out = decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, texts included, with the rate at which each row is to be read and its rounded number of copies; rows with rate 0 go.

    Of equally likely domains the first is given; rows with equal posteriors have equal rates.
    """
    labelled = domain_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labelled, TARGETS, whole=True).where(F.col(free_name(docs, "rate")) > 0)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SimHash, the classifier and the rate fit cannot be written in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again: the rows of the corpus, with texts and rates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
