"""Hard negatives against plain loops: ties, repeats, nulls, lengths, huge numbers, several slabs and blocks."""

import math
import random

import numpy as np
import pytest

from chronoweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    """The contract, row by row with Python's whole numbers."""
    good = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in e):
            continue
        good.append((i, [math.floor(256 * x) for x in e], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: max(-H.MOST, min(H.MOST, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a, va, la in {(i, tuple(v), label) for i, v, label in good if i % every == 0}:
        scored = sorted((-dot(va, v), i, label) for i, v, label in good)
        for p, i, _ in [s for s in scored if s[2] == la and s[1] != a][:5]:
            fit = [(n, j) for n, j, label in scored if label != la and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(fit[:3])]
    return sorted(out)


def got(spark, rows, schema=SCHEMA, **how):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, schema).repartition(3), **how).collect()))


def vectors(n, dims=6, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-spread, spread) for _ in range(dims)], rng.randrange(10)) for i in range(n)]


def test_against_loops(spark):
    rows = vectors(400)
    assert got(spark, rows) == brute(rows)


def test_several_slabs_blocks_and_tiles(spark, monkeypatch):
    rows = vectors(300, seed=2)
    want = brute(rows, every=10)
    assert got(spark, rows, every=10, slab_bytes=900) == want
    monkeypatch.setattr(H, "BLOCK", 4)
    assert got(spark, rows, every=10) == want


def test_ties_repeats_nulls_and_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(260)]  # many equal scores
    rows += [(50, *rows[50][1:])] * 2 + [(60, *rows[60][1:])] * 4
    rows += [(None, [1.0, 1.0, 1.0], 1), (300, None, 1), (301, [1.0, 1.0, 1.0], None), (350, [1.0, None, 1.0], 1), (302, [float("nan"), 1.0, 1.0], 1), (303, [float("inf"), 1.0, 1.0], 2), (304, [1e307, 1.0, 1.0], 2)]
    rows += [(400, [1.0], 1), (401, [1.0, 1.0, 1.0, 1.0, 1.0], 2), (402, [], 1), (450, [], 2)]
    assert got(spark, rows) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(1, 1 << 22)) + i / 256 for _ in range(4)], rng.randrange(2)) for i in range(120)]
    want = brute(rows)
    assert max(w[4] for w in want) > H.EXACT and got(spark, rows) == want
    rows = [(i, [rng.choice([1e200, -1e200, 3.0]), 1.0], rng.randrange(2)) for i in range(101)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("score", [0, 1, 2, 99, 100, 101, 12345, -1, -100, -12345, (1 << 53) + 3, 1 << 61])
def test_window_is_that_of_whole_numbers(score):
    low, high = H.window(np.array([score]), 50, 95)
    assert (int(low[0]), int(high[0])) == (-(-50 * score // 100), 95 * score // 100)


def test_best_and_merge_keep_the_smaller_id_of_equal_scores():
    rng = np.random.default_rng(5)
    s, ids = rng.integers(0, 4, (30, 50)).astype(float), np.arange(100, 150)
    want = [sorted((-x, i) for x, i in zip(row, ids, strict=True))[:5] for row in s]
    halves = [H.best(s[:, a:b].copy(), ids[a:b], 5) for a, b in ((25, 50), (0, 25))]
    score, who = H.merged(*(np.concatenate([h[k] for h in halves], 1) for k in (0, 1)), 5)
    assert [[(-a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(score.tolist(), who.tolist(), strict=True)] == want


def test_floats_other_columns_and_empty_tables(spark):
    rows = vectors(120, seed=6)
    single = [(i, [float(np.float32(x)) for x in e], label) for i, e, label in rows]
    named = spark.createDataFrame(single, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as part", "3 as score")
    assert sorted(map(tuple, H.mine(named).collect())) == brute(single)
    assert got(spark, []) == []
    assert got(spark, vectors(5)[1:]) == []  # no anchor
    assert got(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []  # the anchor's label becomes that of nobody else
