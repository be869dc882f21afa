"""The corpus pipeline: five stages from documents to token records in training order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. Extra columns go along, whatever their names; an empty table gives an empty one. Nulls may be in any
column: a null text counts as empty, a null id as an id of its own, a null source as a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import decontaminate, jaccard_join, mixing, toxicity, training_order
from chronoweave.llm.common import materialize, table
from chronoweave.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, accepts.

    Without labels of both classes all have one score, that of the share of labels. Null and empty texts are scored by the bias alone;
    repeated rows are scored each.
    """
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Documents without words are in no group and stay; a null id counts as the largest; of equal rows one stays.
    """
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; an empty benchmark leaves all."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it. Documents without words stay once; equal rows share their copies."""
    ship_package(spark)
    return mixing.repeated(docs)


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order, written as shards and read back. Null and empty texts are an end of text alone; repeated rows are documents each."""
    ship_package(spark)
    return training_order.written_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_sources", mix_sources),
    ("token_output", order_tokens),
]

#: SQL can't express the trained model, the similarity join at this size, the random mix or the permutation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
