"""Rows that are repeated very often, and arrays that stay bounded."""

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common, mixing


@pytest.mark.parametrize("wide", [1, 7, 1 << 15])
def test_numbers_come_in_bounded_arrays(spark, monkeypatch, wide):
    monkeypatch.setattr(common, "WIDE", wide)
    rows = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 0), ("e", None), ("f", 50)], "_block string, n long")
    got = common.numbered(rows, "n", "k")
    assert got.columns == ["_block", "n", "k"]
    assert sorted((r._block, r.k) for r in got.collect()) == [(x, k) for x, n in (("a", 1), ("b", 7), ("c", 8), ("f", 50)) for k in range(1, n + 1)]


def test_a_row_repeated_a_million_times(spark):
    one = spark.range(1).select(F.lit("a b c").alias("text"), F.lit(10**6).cast("long").alias("n"))
    assert common.numbered(one, "n", "k").agg(F.count(F.lit(1)), F.max("k"), F.countDistinct("k")).first() == (10**6, 10**6, 10**6)
    docs = spark.range(10**6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 1000, "x").otherwise("y").alias("source"))
    mixed = mixing.repeated(docs, cycle=(1, 1), most=3.0).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in mixed} == {"x": 3000, "y": 997000}
