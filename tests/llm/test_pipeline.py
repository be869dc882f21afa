"""The pipeline's stages, each against what its own input says."""

from collections import Counter

import numpy as np

import corpus_pipeline
from chronoweave.llm import training_order
from chronoweave.llm.common import materialize
from tests.llm.test_operators import brute_components, brute_leaks, brute_targets, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    start, civil, single, clean, mixed, ordered = kept
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in start} - {r.doc_id for r in civil}
    assert gone and sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(i in labels for i in gone)
    assert {r.doc_id for r in single} == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in civil])}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {x[0] for x in brute_leaks([(r.doc_id, r.text) for r in single], items) if not x[5]}
    size, longest, taken = Counter(), Counter(), Counter()
    for r in clean:
        size[r.source] += len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
    for r in mixed:
        taken[r.source] += len(words(r.text))
    want = brute_targets(dict(size))
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in size) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert sorted(r.slot for r in ordered) == list(range(len(ordered)))
    tool = training_order.encoding(training_order.read_ranks(training_order.TOKENIZER))
    tokens = Counter(r.doc_id for r in ordered for _ in range(r.n_tokens))
    for r in clean[:50]:
        assert tokens[r.doc_id] == sum(m.doc_id == r.doc_id for m in mixed) * (len(tool.encode_ordinary(r.text or "")) + 1)
    assert {len(np.frombuffer(r.tokens, "<u2")) for r in ordered} == {512}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows_and_on_none(spark, edge_docs, empty_docs):
    """Nulls in every column, empty and long texts, repeated rows and names that stages use; and an empty table."""
    for docs, some in ((edge_docs, True), (empty_docs, False)):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialize(stage(spark, docs, SF), f"odd-{name}")
            assert k == 4 or docs.columns == columns, name
            assert (docs.count() > 0) == some, name
        if some:
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert None in ids and {100, 101, 106, 107} <= ids and 104 not in ids or 103 not in ids
