"""Rows by their full value, names that meet the operators' own, bounded cells and samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, jaccard_join, labelled, mixing, toxicity, training_order
from tests.llm.conftest import prose

NAMES = ["ROW", "row_id", "Bucket", "listed", "CLASS_ID", "stays", "times", "n", "CID", "parity", "part", "task", "data", "leak", "_LEAK", "_leak_found", "_toxicity", "_mix_row", "_mix_copy", "copies", "Taken", "_key", "_node", "_join_row", "Size", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(12)]
    rows = [(i, texts[i % 10], "en", None if i % 4 == 0 else f"s{i % 3}") for i in range(14)]
    # equal but for which column is null
    rows += [(50, texts[11], "x", None), (50, texts[11], None, "x"), (50, texts[11], None, "x"), (60, None, None, None), (60, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def test_nulls_in_either_of_two_columns_are_different_rows(docs):
    mixed = mixing.repeated(docs, cycle=(1,), most=1.0).where("doc_id = 50").groupBy("lang", "source").count().collect()
    assert {(r.lang, r.source): r["count"] for r in mixed} == {("x", None): 1, (None, "x"): 2}
    kept = jaccard_join.keep_one(docs).collect()
    assert len([r for r in kept if r.doc_id == 50]) == 1 and len([r for r in kept if r.doc_id == 60]) == 2


def test_columns_named_as_the_operators_own(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(14)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text)], "item_id long, text string")
    for out in (jaccard_join.keep_one(docs), mixing.repeated(docs), decontaminate.clean(docs, bench), decontaminate.clean(docs, bench.unionByName(bench), block_bytes=50), toxicity.drop_toxic(docs, labels)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    marked = decontaminate.mark(docs, bench, column="leak")
    assert marked.where("leak.contaminated").count() == 2 and len(marked.columns) == len(docs.columns)
    assert training_order.training_order(docs).count() == docs.count()


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 16), dtype=np.uint64)
    bits = base[rng.integers(0, 6, 200)].copy()
    for r in bits:  # up to 12 bits away from a centre
        for _ in range(rng.integers(0, 13)):
            r[rng.integers(0, 16)] ^= np.uint64(1) << np.uint64(rng.integers(0, 63))
    n = rng.integers(80, 100, 200)
    side = rng.integers(0, 2, 200)
    got = jaccard_join.forest(n, bits, lambda i: side != side[i])
    i, j = np.triu_indices(200, 1)
    ok = (jaccard_join.may_link(n, bits, i, j) >= 0) & (side[i] != side[j])

    def groups(pairs):
        up = list(range(200))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        for k in range(200):
            up[k] = up[up[k]]
        return [next(iter([up[k]])) for k in range(200)]

    flat = lambda up: [min(m for m in range(200) if root(up, m) == root(up, k)) for k in range(200)]

    def root(up, k):
        while up[k] != k:
            k = up[k]
        return k

    assert flat(groups(got)) == flat(groups(zip(i[ok].tolist(), j[ok].tolist(), strict=True)))
    assert len(got) < ok.sum()


def test_cells_larger_than_the_small_ones_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    rng = random.Random(6)
    base = [prose(rng, 1) for _ in range(60)]
    rows = []
    for i in range(70):  # a large group of near copies, by chains of single changes
        if i % 3 == 0:
            base[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(base)))
    from tests.llm.test_operators import brute_components, rows_of

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.join(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    modes = dict.fromkeys(range(1, 20), jaccard_join.DELETE)
    assert rows_of(jaccard_join.join(docs, modes=modes), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, toxic int")
    assert labelled.sample(docs, labels, "toxic", 10).count() <= 3


def test_a_document_repeated_often_is_many_rows_of_the_mix(spark):
    docs = spark.range(9000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 6000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, chunk=512, fan=4).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in got) and sum(r.rows for r in got) == 9000


def test_shards_are_checked_when_read(spark, docs, tmp_path):
    ordered = training_order.training_order(docs, shard_slots=4)
    path = str(tmp_path / "shards")
    training_order.write_shards(ordered, path)
    want = {r.slot: bytes(r.tokens) for r in ordered.select("slot", "tokens").collect()}
    for start in (0, 5, len(want) - 1, len(want)):
        got = {r.slot: bytes(r.tokens) for r in training_order.read_shards(spark, path, start=start).collect()}
        assert got == {k: v for k, v in want.items() if k >= start}
    bad = str(tmp_path / "bad")
    spark.read.parquet(path).withColumn("crc32", F.col("crc32") + 1).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        training_order.read_shards(spark, bad).collect()
