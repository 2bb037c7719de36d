"""Bounded samples of labelled rows on which the models are fitted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals.llm.text import id_and_text


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, per_class: int, seed: int = 0) -> DataFrame:
    """Whole texts of about ``per_class`` documents of each class: ``doc_id, text, label, weight``.

    A document is taken if the hash of its identifier, as a number from 0 to 1,
    lies below ``per_class`` over the size of its class: no rank is needed, the
    choice does not depend on partitions, and a class with fewer documents is
    taken whole. Rows without identifier or label are left out; a document with
    several labels has the smallest one, one with several texts the greatest.
    Without ``labels`` the documents carry the label themselves, and the text is
    that of a row with it. ``weight`` is the number of labelled documents that a
    sampled one stands for. What is broadcast has about ``per_class`` short rows
    per class, for as many classes as there are labels (languages, or two).
    """
    rows = id_and_text(docs)
    if labels is None:
        labels = docs
        text, name = F.col("text").cast("string").alias("text"), F.col(label).alias("label")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, name)
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    weight = F.greatest(F.lit(1.0), F.count(F.lit(1)) / F.lit(per_class))
    classes = given.groupBy("label").agg(weight.alias("weight"))
    place = F.xxhash64(F.col("doc_id"), F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)
    # One row per class, and then about per_class rows for each.
    picked = given.join(F.broadcast(classes), "label").where(place * F.col("weight") < 1)
    return (
        rows.join(F.broadcast(picked), [c for c in rows.columns if c != "text"])
        .groupBy("doc_id", "label", "weight")
        .agg(F.max("text").alias("text"))
        .select("doc_id", "text", "label", "weight")
    )


def lists_of(table: pa.Table, *columns: str) -> list[tuple[np.ndarray, ...]]:
    """The rows of list columns as arrays, by ``doc_id``; they look into the table's memory and copy nothing."""
    rows = []
    for batch in table.to_batches():
        lists = [batch.column(c) for c in columns]
        at = lists[0].offsets.to_numpy()
        values = [x.values.to_numpy() for x in lists]
        rows += [tuple(v[a:b] for v in values) for a, b in zip(at, at[1:])]
    return [rows[i] for i in by_id(table)]


def by_id(table: pa.Table) -> np.ndarray:
    return np.argsort(table["doc_id"].to_numpy(), kind="stable")
