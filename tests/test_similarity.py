"""Similarity joins, components and reachable nodes against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import graph, similarity as S

SCHEMA = "id long, v array<double>"


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def brute(rows, limit):
    """All pairs of distinct vectors of one length, and every row's group."""
    used = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    rep = {}
    for i, v in used:
        rep[v] = min(i, rep.get(v, i))
    names = sorted(rep.items(), key=lambda x: x[1])
    pairs = {}
    for k, (v, a) in enumerate(names):
        for w, b in names[k + 1 :]:
            if len(v) == len(w) and (total := sum(abs(x - y) for x, y in zip(v, w, strict=True))) <= limit * len(v):
                pairs[a, b] = total
    root = roots(pairs)
    of = {r: [(i, rep[v]) for i, v in used if root.get(rep[v]) == r] for r in set(root.values())}
    groups = sorted((i, r, len({x for _, x in m}), len(m)) for r, m in of.items() for i, _ in m)
    return pairs, groups


def check(spark, rows, limit, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as rep", "3 as label").repartition(3)
    pairs, groups = brute(rows, limit)
    assert {(r.a, r.b): pytest.approx(r.total) for r in S.near_pairs(df, "id", "v", limit, **how).collect()} == pairs
    assert sorted(map(tuple, S.near_groups(df, "id", "v", limit, **how).collect())) == groups
    return pairs, groups


def moved(rng, v, total):
    """v with its components moved by `total` in all, in random shares."""
    share = [rng.random() ** 4 for _ in v]
    return [x + rng.choice([-1, 1]) * total * s / sum(share) for x, s in zip(v, share, strict=True)]


@pytest.mark.parametrize(("size", "bands", "worth"), [(16, 4, 24), (64, 8, 1), (5, 8, 2), (24, 3, 0)])
def test_pairs_and_groups_against_all_pairs(spark, size, bands, worth):
    rng = random.Random(size)
    base = [[rng.gauss(0, 30) for _ in range(size)] for _ in range(40)]
    rows = list(enumerate(base)) + [(100 + i, moved(rng, base[i % 40], size * rng.choice([0.5, 1.9, 1.999, 2.001, 2.4]))) for i in range(80)]
    rows += [(300 + i, base[i]) for i in range(5)] + [(400, moved(rng, rows[50][1], size * 1.9))]
    pairs, groups = check(spark, rows, 2.0, bands=bands, worth=worth)
    assert pairs and groups


def test_differences_in_a_few_components_or_in_all(spark):
    """The bound of a band holds wherever the difference lies."""
    zero = [0.0] * 32
    rows = [(0, zero), (1, [2.0] * 32), (2, [64.0] + zero[1:]), (3, zero[1:] + [-64.0]), (4, [8.0 if k % 8 == 3 else 0.0 for k in range(32)]), (5, [64.1] + zero[1:]), (6, [-2.0] * 32)]
    pairs, _ = check(spark, rows, 2.0, bands=8, worth=0)
    assert {(0, 1), (0, 2), (0, 3), (0, 4)} <= set(pairs) and (0, 5) not in pairs and (1, 6) not in pairs


def test_whole_numbers_at_the_limit(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(0, 4)) for _ in range(12)]) for i in range(150)]
    check(spark, rows, 1, bands=4, worth=1)


def test_dense_clusters_and_vectors_with_equal_bands(spark):
    """Hundreds of vectors within the limit of each other, and hundreds that are zero but for a few components."""
    rng = random.Random(5)
    one = [rng.gauss(0, 30) for _ in range(16)]
    rows = [(i, moved(rng, one, 8.0)) for i in range(150)]
    for i in range(150):
        v = [0.0] * 16
        v[rng.randrange(16)] = rng.uniform(0, 500)
        rows.append((1000 + i, v))
    pairs, groups = check(spark, rows, 2.0, bands=4, worth=0.5)
    assert len(pairs) > 150 * 149 // 4 and max(g[2] for g in groups) >= 150


def test_a_chain_of_near_vectors_is_one_group(spark):
    rows = [(i, [3.0 * i, 0.0, 0.0, 0.0]) for i in range(60)]
    _, groups = check(spark, rows, 1, bands=2, worth=0.5)
    assert {g[1:] for g in groups} == {(0, 60, 60)}


def test_rows_that_are_not_usable(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(1, good), (2, good), (None, [1.0, 2.0, 3.1]), (3, None), (4, []), (5, [1.0, None, 3.0]), (6, [float("nan"), 2.0, 3.0]), (7, [float("inf"), 2.0, 3.0]), (8, [1.0, 2.0]), (9, [-0.0, 0.0, 0.0]), (10, [0.0, 0.0, 0.0]), (11, [1.0, 2.0, 3.2])]
    _, groups = check(spark, rows, 0.5, bands=2)
    assert [g[0] for g in groups] == [1, 2, 11]
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_pairs(empty, "id", "v", 1.0).collect() == [] and S.near_groups(empty, "id", "v", 1.0).collect() == []


def test_a_copy_of_most_rows_is_one_vector(spark):
    df = spark.range(3000).selectExpr("id", "if(id < 2000, array(1D, 2D), array(1D * id * 10, 0D)) as v").unionByName(spark.createDataFrame([(9999, [1.0, 2.5])], SCHEMA))
    got = S.near_groups(df, "id", "v", 1.0).groupBy("component", "vectors", "members").count().collect()
    assert [tuple(r) for r in got] == [(0, 2, 2001, 2001)]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cycle"])
def test_components(spark, kind):
    rng = random.Random(1)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "chain": [(i, i + 1) for i in range(200)] + [(500 - i, 501 - i) for i in range(100)],
        "star": [(999, i) for i in range(300)],
        "cycle": [(i, (i + 1) % 50) for i in range(50)] + [(60, 60)],
    }[kind]
    got = graph.components(spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == roots((a, b) for a, b in links if a != b)


def test_components_of_names_and_of_nothing(spark):
    got = graph.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert graph.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_reachable_nodes_with_cycles(spark):
    rng = random.Random(2)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(100, 101), (101, 102), (102, 100), (None, 3), (3, None)]
    starts = [0, 5, 7, 100, 777]
    want = set()
    for s in starts:
        seen, front, steps = {s: 0}, [s], 0
        while front:
            steps += 1
            front = [b for b in {b for a, b in links if a in front and a is not None and b is not None} if b not in seen]
            seen |= dict.fromkeys(front, steps)
        want |= {(s, n, k) for n, k in seen.items()}
    got = graph.reachable(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(s,) for s in [*starts, 5, None]], "start long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_plan_has_a_cross_join(spark, capsys):
    df = spark.range(200).select("id", F.array(*(F.rand(k) for k in range(8))).alias("v"))
    S.near_pairs(df, "id", "v", 0.1).explain("formatted")
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan

@pytest.mark.parametrize("share", [1, 0.01])
def test_entries_are_made_once_and_small(spark, monkeypatch, share):
    """Rows with their axes are written once, not a level of axes, and few a vector."""
    made, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df, tag: made.append((tag, keep(df, tag))) or made[-1][1])
    rng = np.random.default_rng(4)
    base = rng.normal(0, 32 * share, (1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5000 + i, (v + 0.5 * share).tolist()) for i, v in enumerate(base[:200])]
    found = S.near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "v", 3 * share, worth=24)
    assert {(r.a, r.b) for r in found.collect()} == {(i, 5000 + i) for i in range(200)}
    entries = [df for tag, df in made if tag == "near-entries"]
    assert len(entries) == 1 and entries[0].count() < 1700 * 8 * 12
    assert not [f for f in entries[0].schema if f.dataType.typeName() == "array"]
