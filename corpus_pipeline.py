"""The corpus pipeline: each stage works on what the one before it kept and is written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.llm import decontaminate, langid, lines, mixing, simhash
from payproof.llm._common import fold_of, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; ``und`` goes.  Learned from the folds other than 0 of this input."""
    model = langid.fit(docs.where(fold_of(F.col("doc_id")) != 0))
    return langid.keep_known(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes globally repeated chunks of lines out of the texts; n_chars follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, found by
    their SimHash fingerprints."""
    return simhash.near_first(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item was found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with the words that the mix takes of it and how often, for weights 5, 2, 1 over the
    sources: the corpus is the texts with copies."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: SQL cannot express the language model, the components or the flow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
