"""What the operators must do for all of the input, whatever its size."""

import random
from collections import Counter

import numpy as np
import pyarrow.compute as pc

from chronoweave.llm import lm, toxicity
from chronoweave.llm.common import materialize
from tests.llm.conftest import prose


def test_lm_tables_have_an_entry_for_each_context_of_the_corpus(spark):
    """Counts are those of the true contexts, over all blocks; a table of fixed size would mix them."""
    rng = random.Random(9)
    texts = {i: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(3000)) + " common words at the end" for i in range(8)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    blocks = materialize(lm.packed(docs), "test-blocks")
    rows = [r.asDict() for r in blocks.collect()]
    book = lm.code(np.sum([r["hist"] for r in rows], 0))
    length, nodes, bits, start = book
    path = lambda before, byte: [(int(nodes[i]), int(bits[i])) for i in range(start[before * 256 + byte], start[before * 256 + byte] + length[before * 256 + byte])]
    reach = 5
    seen, words = Counter(), Counter()
    for r in rows:
        for i, kind in zip(r["ids"], r["folds"], strict=True):
            spelt = [*(w.encode() + b" " for w in texts[int(i)].split()), b"\n"]
            words.update(spelt if kind != lm.HELD_OUT else [])
            if kind in (lm.HELD_OUT, lm.WEIGHTS):
                continue
            for w in spelt:
                for b in range(len(w)):
                    seen.update((w[max(0, b - reach) : b], n, x) for n, x in path(w[b - 1] if b else 32, w[b]))
    found = materialize(lm.tables(blocks, book, 64), "test-tables").toArrow()
    assert len({r for r in found["part"].to_pylist()}) > 64 * lm.K  # all ranges of the predictors with many contexts, and more
    for r in rows:
        mine = found.filter(pc.equal(found["block"], r["block"]))
        block = lm.Texts(r, lm.answers(mine, 64), book, 64)
        k = lm.REACH.index(reach)
        spelling = block.block.spelling.tobytes()
        for i, (a, b) in enumerate(zip(block.block.ends[:-1].tolist(), block.block.ends[1:].tolist(), strict=True)):
            w = spelling[a:b]
            assert block.count[i] == words[w]
            want = [(c := w[max(0, j - reach) : j], n) for j in range(len(w)) for n, _ in path(w[j - 1] if j else 32, w[j])]
            want = lm.states(np.array([[seen[c, n, 0], seen[c, n, 1]] for c, n in want]))
            assert (block.state[k][block.start[i] : block.start[i + 1]] == want).all()


def test_lm_ranges_grow_with_the_corpus():
    assert lm.ranges_for(0) == lm.LEAST_RANGES
    assert lm.ranges_for(30 << 30) >= (30 << 30) // lm.RANGE


def test_toxicity_learns_from_labels_beyond_the_sample(spark):
    """A word in 10 % of the toxic documents, none of which need be in the sample, marks a document as toxic."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(2000):
        toxic = i % 2
        word = ("zzyxqu" if i % 20 == 1 else "gronkel") if toxic else "hello"
        docs.append((i, f"{prose(rng, 5)} {word} {prose(rng, 5)}"))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    picked = {r.doc_id for r in toxicity.sample(docs, labels, "toxic", 20).collect()}
    model = toxicity.fit(docs, labels, per_class=20)
    some = spark.createDataFrame([(1, "kaban lodor zzyxqu mifel negis puhum"), (2, "kaban lodor mifel hello negis puhum")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    assert len(picked) == 40 and got[1] > 0.5 > got[2]
    seen = toxicity.frequencies(docs, labels, "toxic")
    assert seen[:, -1].sum() == sum(1 for r in labels.select(~toxicity.held_out()).collect() if r[0])
    bucket = np.unique(toxicity.gram_buckets(np.frombuffer(b"zzyxqu", np.uint8), np.array([0, 6]))[0])
    assert toxicity.informative(seen, 4.0)[bucket].mean() > 0.9  # a bucket may be shared with a common n-gram
