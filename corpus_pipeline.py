"""A training-text pipeline: toxicity, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.llm import exact, jaccard, packing, suffix, toxicity
from pepspark.llm.common import materialize, train_rows
from pepspark.llm.queries import vocabulary


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below 0.3; learned from three quarters of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(train_rows("doc_id", 4, 2))
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.clean_rows(docs, model, 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in ASCII white space only."""
    return exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles."""
    return jaccard.kept_rows(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or of 400 bytes, that occur twice; n_chars follows."""
    return suffix.cut_rows(docs, length=400, words=51).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each remaining document goes; see ``packing.pack``."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_passages),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: Learned scores and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
