"""Corpus pipeline: toxicity, exact and near duplicates, decontamination, mixing.

Every stage works on all rows its predecessor kept and is written as Parquet in
the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.session import stored
from tablescope.llm.decontaminate import drop_contaminated
from tablescope.llm.exact_dedup import drop_exact_duplicates
from tablescope.llm.mixing import mix
from tablescope.llm.simhash import drop_near_duplicates
from tablescope.llm.toxicity import drop_toxic, fit_toxicity


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from; the others are held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted lexicon doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, training_labels(labels)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts, the one with the largest id."""
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return drop_near_duplicates(docs, shingle=4, bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rate that matches the target weights; those with rate 0 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, training_labels(labels)).filter("rate > 0")


STAGES = [
    ("toxicity", toxicity),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learning and fingerprints have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
