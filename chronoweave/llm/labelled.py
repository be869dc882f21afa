"""Bounded samples of labelled documents for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import fold

FOLDS = 5


def held_out() -> F.Column:
    """True for the documents whose labels no model sees."""
    return fold("doc_id", FOLDS) == 0


def seen_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of the documents whose labels a model may see, each pair once."""
    return labels.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label of at most `per_class` labelled documents of each of the classes 0 and 1, never held-out ones.

    The documents with the smallest hashes of their ids are taken, by a distributed top-k, so the result is bounded,
    repeatable and independent of the order of rows. Of the rows of one doc_id, however many, the one with the smallest
    hash of its text stands for it. Null labels and labels without a document don't count.
    """
    seen = seen_labels(labels, label)
    order = F.xxhash64(F.lit(label), "doc_id")
    picked = [seen.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def prior(labels: DataFrame, label: str) -> float:
    """Share of class 1 in all labels that may be seen, a little drawn to one half."""
    r = labels.where(~held_out()).select(F.col(label).cast("int").alias("y")).where("y in (0, 1)").agg(F.sum("y"), F.count("y")).first()
    return ((r[0] or 0) + 1) / (r[1] + 2)
