"""The corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, tokens.

Every stage reads what the one before wrote. All but the last return the columns of documents as they were; the last
returns doc_id, token ids and the byte offset of each token. Stages work on all rows they are given; what a stage
rejects is gone for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.llm import bpe, decontam, jaccard, pii, rules
from demandry.llm.common import table
from demandry.llm.queries import PSEUDONYM_KEY, rank_file
from demandry.session import fresh_path, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; cutoffs are certified on the labelled ones among them."""
    measured = materialize(rules.measure(docs), "counts")
    cutoffs = materialize(rules.certify(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return rules.keep(docs, cutoffs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least key; documents without words are no duplicates.

    Near are texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return jaccard.representatives(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data in their texts."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and offsets of the texts as they now are."""
    encoded = bpe.encode(docs.select("doc_id", "text"), rank_file())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", pseudonyms),
    ("tokens", tokens),
]

# Trained cutoffs and merges by rank are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
