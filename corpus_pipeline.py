"""A corpus from raw documents to training sequences, in five stages.

Every stage is written as Parquet and read again by the next, so a lost executor
costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repo_signals.llm.line_templates import without_recurring_lines
from repo_signals.llm.ngram_join import one_of_each_group
from repo_signals.llm.packing import binary_pieces
from repo_signals.llm.quality_model import fit_quality_model, of_quality
from repo_signals.llm.queries import documents, fold, labels
from repo_signals.llm.secret_scan import without_secrets
from repo_signals.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of four folds of five, does not reject."""
    return of_quality(docs, fit_quality_model(docs, labels(spark, sf_dir), fold(5) != 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents."""
    return without_recurring_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their token ids."""
    return binary_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

# A classifier that is fitted step by step has no SQL twin; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
