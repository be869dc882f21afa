"""Packing: token ids against the library they are defined by, first fit against a plain loop, gaps, splits and edge rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import packing, registry
from tests.llm.conftest import SCHEMA, prose

SF = "/root/testdata/sf0.001"


def wanted(rows):
    """Ids of each (doc_id, text), end included, as the contract has them."""
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return Counter((i, tuple(tool.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)


def check(packed, rows, length=2048):
    """Pieces make up every document, sequences are gapless, digests are of the pieces."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    want = wanted(rows)
    assert sum(len(p[2]) for parts in docs.values() for p in parts) == sum(len(x) * n for (_, x), n in want.items())
    for i, whole in want:
        if sum(n for (j, _), n in want.items() if j == i) == 1:  # one document of this id
            parts = sorted(docs[i])
            assert [p[0] for p in parts] == np.cumsum([0, *(len(p[2]) for p in parts)])[:-1].tolist()
            assert {p[1] for p in parts} == {len(whole)} and sum((p[2] for p in parts), ()) == whole
        else:
            assert {whole[a : a + n] for a, _, x in docs[i] for n in [len(x)]} & {x for *_, x in docs[i]}
    return sequences


@pytest.mark.parametrize("n", [1, 2, 5, 300])
def test_first_fit_is_that_of_a_plain_loop(n):
    rng = random.Random(n)
    sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
    room, want = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= s
    found, offset = packing.first_fit(np.array(sizes), 100)
    assert list(zip(found.tolist(), offset.tolist(), strict=True)) == want


def test_gaps_are_closed_and_nothing_is_lost():
    sizes = np.full(50, 60)
    placed = packing.close_gaps(sizes, *packing.first_fit(sizes, 100), 100, 8)
    assert Counter(i for i, *_ in placed for _ in [0]).keys() == set(range(50))
    assert sum(n for _, _, n, _, _ in placed) == 3000 and len({s for *_, s, _ in placed}) == 30
    for s in {s for *_, s, _ in placed}:
        inside = sorted((o, n) for _, _, n, q, o in placed if q == s)
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:], strict=False)) and sum(n for _, n in inside) <= 100
    assert len(packing.close_gaps(sizes, *packing.first_fit(sizes, 100), 100, 41)) == 50  # gaps too small to cut for


def test_query_against_the_library_and_a_plain_count(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    sequences = check(got.collect(), rows)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) * 2048 - used < 2048 + 0.02 * used
    query = registry.QUERIES["op11_packing"](spark, SF)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, query.collect())) == sorted(tuple(r)[:-1] for r in got.collect())


def test_same_result_for_any_file_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(map(tuple, packing.pack(x, group_pieces=40).collect())) for x in (docs.coalesce(1), docs.repartition(7)))
    assert a == b and len({r[5] >> 32 for r in a}) > 2


def test_edge_rows(spark, edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(packing.pack(edge_docs).collect(), rows)
    assert packing.pack(empty_docs).collect() == []
    special = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "é\U0001f600 " * 3000), (4, None), (5, "x" * 20000)]
    check(packing.pack(spark.createDataFrame(special, "doc_id long, text string")).collect(), special)
    named = spark.createDataFrame([("a", "one"), (None, "two")], "doc_id string, text string").selectExpr("*", "1 as key", "2 as ids", "3 as start", "4 as `group`")
    assert sorted((r.doc_id or "", r.length) for r in packing.pack(named).collect()) == [("", 2), ("a", 2)]


def test_rows_repeated_often_spread_over_groups(spark):
    rng = random.Random(2)
    text = prose(rng, 20)
    docs = spark.range(3000).selectExpr("if(id < 2000, 7, id) as doc_id", f"'{text}' as text")
    got = packing.pack(docs, group_pieces=200).collect()
    groups = Counter(r.sequence_id >> 32 for r in got if r.doc_id == 7)
    assert sum(groups.values()) >= 2000 and max(groups.values()) < 400


def test_padded_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * i, None, None, None) for i in range(1, 60)], SCHEMA)
    packed = packing.pack(docs, length=64, least_cut=4)
    for r in packing.sequences(packed, pad=9, length=64).collect():
        ids = np.frombuffer(r.tokens, "<u4")
        assert len(ids) == (r.n_tokens if bin(r.n_tokens).count("1") == 1 else 64) and (ids[r.n_tokens :] == 9).all()
        assert r.n_pieces == Counter(x.sequence_id for x in packed.collect())[r.sequence_id]
