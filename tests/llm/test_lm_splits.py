"""Language-model scores hang on the rows alone, and what the first decision's gates see is what came before."""

import random

import numpy as np
import pytest

from chronoweave.llm import lm
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(260)]
    texts[200:230] = texts[:30]  # copies
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()


def scores(df):
    return {r.doc_id: (r.score, r.base_score, r.n_bytes) for r in lm.score(df).collect()}


def test_scores_are_the_same_for_any_files_and_tasks(docs):
    assert scores(docs.coalesce(1)) == scores(docs.repartition(5)) == scores(docs.repartition(3, "text").sortWithinPartitions("text"))


def test_held_out_copies_are_known_and_others_are_no_worse_than_words(docs):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    copies = [r for i, r in got.items() if r.held_out and (i < 30 or 200 <= i < 230) and r.n_tokens > 40 and not got[(i + 200) % 400 if i < 30 else i - 200].held_out]
    assert copies and all(r.score > 0.7 * r.base_score for r in copies)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_past_of_first_decisions():
    listing = np.array([1, 1, 0, 1, 1, 1, 0, 1], np.uint8)
    naming = np.array([1, 0, 0, 1, 1, 0, 0, 1], np.uint8)
    got = lm.past(listing, naming, np.array([0, 4, 4, 8]))
    assert got.tolist() == [8, 7, 8, 3, 8, 7, 8, 3]


def test_shares_of_two_ways_to_a_word_are_a_probability():
    """Each step's bits lie between those of the better way and one bit more, and shares go to the way that does better."""
    rng = np.random.default_rng(3)
    spelt, plain, share, total = rng.uniform(5, 20, 400), rng.uniform(5, 8, 400), 0.5, 0.0
    for s, p in zip(spelt, plain, strict=True):
        bits = -np.logaddexp2(np.log2(share) - p, np.log2(1 - share) - s)
        assert min(s, p) - 1e-9 <= bits <= min(s - np.log2(1 - share), p - np.log2(share)) + 1e-9
        share = 0.99 * share + 0.01 * np.exp2(np.log2(share) - p + bits)
        total += bits
    assert share > 0.9 and total < plain.sum() + 100
