"""Training order: numbers by content, the permutation of ranks, shards written in stripes, resumed and read back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import training_order as T
from tests.llm.conftest import prose

SMALL = {"seq_len": 16, "shard_slots": 8}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, prose(rng, rng.randint(0, 40)) if i % 9 else None) for i in range(120)], "doc_id long, text string").cache()


def rows_of(df):
    return sorted((r.slot, r.doc_id if r.doc_id is not None else -1, r.piece, r.n_tokens, r.shard, r["at"], bytes(r.tokens)) for r in df.collect())


def test_order_is_the_same_for_any_files_and_tasks(spark, docs):
    want = rows_of(T.training_order(docs, **SMALL))
    assert [r[0] for r in want] == list(range(len(want))) and len(want) > 200
    for n in (1, 7):
        assert rows_of(T.training_order(docs.repartition(n), **SMALL)) == want
    assert rows_of(T.training_order(docs, seed=30, **SMALL)) != want


def test_slots_are_the_permuted_ranks_of_content(spark, docs):
    tool = T.encoding(T.read_ranks(T.TOKENIZER))
    pieces = []
    for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")).collect():
        x = [*tool.encode_ordinary(r.text or ""), 50256]
        pieces += [(r.a, r.b, k, r.doc_id, np.array((x[at : at + 16] + [50256] * 16)[:16], "<u2").tobytes()) for k, at in enumerate(range(0, len(x), 16))]
    pieces.sort()
    slot = T.feistel(np.arange(len(pieces)), len(pieces), 29)
    want = {int(s): (p[3], p[2], p[4]) for s, p in zip(slot, pieces, strict=True)}
    assert {r[0]: (r[1], r[2], r[6]) for r in rows_of(T.training_order(docs, **SMALL))} == want


def test_shards_in_stripes_are_those_in_one_go_and_come_back(spark, docs, tmp_path):
    want = rows_of(T.training_order(docs, **SMALL))
    for stripes in (1, 4, 1000):
        path = str(tmp_path / f"s{stripes}")
        assert rows_of(T.written_order(docs, path=path, stripes=stripes, **SMALL)) == want
        shards = spark.read.parquet(path)
        assert shards.count() == -(-len(want) // 8) and {r.stride for r in shards.select("stride").collect()} == {32}
    got = {r.slot: bytes(r.tokens) for r in T.read_shards(spark, str(tmp_path / "s4"), start=21).collect()}
    assert got == {r[0]: r[6] for r in want if r[0] >= 21}


def test_a_killed_write_goes_on_from_the_shards_that_are_there(spark, docs, tmp_path, monkeypatch):
    path, calls, write = str(tmp_path / "shards"), [], T.append_shards

    def breaks(rows, to):
        calls.append(1)
        if len(calls) == 3:
            rows = rows.withColumn("tokens", F.when(F.col("slot") >= 0, F.raise_error(F.lit("killed"))).otherwise(F.col("tokens")))
        write(rows, to)

    monkeypatch.setattr(T, "append_shards", breaks)
    with pytest.raises(Exception, match="killed"):
        T.written_order(docs, path=path, stripes=5, **SMALL)
    there = {r.shard for r in spark.read.parquet(path).select("shard").collect()}
    files = {r.shard: bytes(r.payload) for r in spark.read.parquet(path).collect()}
    assert there and there == set(range(max(there) + 1))
    monkeypatch.setattr(T, "append_shards", lambda rows, to: (calls.append(rows), write(rows, to)))
    calls.clear()
    assert rows_of(T.written_order(docs.repartition(5), path=path, stripes=5, **SMALL)) == rows_of(T.training_order(docs, **SMALL))
    assert len(calls) == 3  # two of five stripes were there
    assert files.items() <= {r.shard: bytes(r.payload) for r in spark.read.parquet(path).collect()}.items()


def test_edges_and_what_is_left_behind(spark, edge_docs, empty_docs, tmp_path):
    got = rows_of(T.written_order(edge_docs, **SMALL))
    assert [r[0] for r in got] == list(range(len(got))) and sum(r[2] == 0 for r in got) == edge_docs.count()
    assert T.written_order(empty_docs, **SMALL).collect() == []
    named = spark.createDataFrame([("x", "a b c"), (None, None)], "doc_id string, text string").selectExpr("*", "1 as a", "2 as place", "3 as slot")
    assert sorted((r.doc_id or "", r.n_tokens) for r in T.written_order(named).collect()) == [("", 1), ("x", 4)]
