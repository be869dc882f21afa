"""Windows, samples and lookups on rows with nulls, ties and nothing in them."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import windows as W


def test_angle_clusters_as_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([rng.uniform(-90, 90), 10.0]), rng.randrange(5), rng.randrange(5)) for i in range(200)] + [(1, 900, None, 1, 1)]
    want = set()
    for e in (1, 2, None):
        clusters = []
        for r in sorted((r for r in rows if r[0] == e and r[2] is not None), key=lambda r: (-r[2], r[1])):
            if not clusters or abs(r[2] - sum(x[2] for x in clusters[-1]) / len(clusters[-1])) > 3:
                clusters.append([])
            clusters[-1].append(r)
        want |= {(e, no, max(c, key=lambda r: (r[3], -r[4], -r[1]))[1], len(c)) for no, c in enumerate(clusters)}
    got = W.angle_clusters(spark.createDataFrame(rows, "entity long, event_id long, angle double, size long, distance long"), 3.0)
    assert {(r.entity, r.cluster_no, r.event_id, r.members) for r in got.collect()} == want


def test_runs_and_segments_of_odd_shapes(spark):
    raw = [(1, 1, "a", "5", "7", None), (1, 2, "", "1", "2", "x"), (1, 3, "b", "nan", "2", "x"), (1, 4, "b", "3", None, "x"), (1, 5, "b", "9", "8", "x"), (1, 6, "c", "1.5", "1.5", ""), (None, 1, "a", "1", "2", "q"), (1, 7, None, "1", "2", "x")]
    got = W.normalized_runs(spark.createDataFrame(raw, "entity long, position int, stage string, start_s string, end_s string, run_id string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, "c", 1.5, 1.5, "run_006"), (1, 2, "a", 5.0, 7.0, "run_001"), (None, 1, "a", 1.0, 2.0, "q")}
    shape = "array<struct<start_s: double, end_s: double>>"
    records = [(1, [(0.0, 1.0), (1.0, 2.0)], [(9.0, 9.0)]), (2, None, [(0.0, 2.0), (1.0, 3.0)]), (3, None, None), (4, [], None)]
    got = W.normalized_segments(spark.createDataFrame(records, f"entity long, segments {shape}, actions {shape}"))
    assert sorted((r.entity, r.position if r.position is not None else -1, r.error or "") for r in got.collect()) == [(1, 0, ""), (1, 1, ""), (2, 0, "overlap"), (2, 1, "overlap"), (3, -1, "missing"), (4, -1, "missing")]


def test_samples_of_short_windows_and_few_rows(spark):
    windows = spark.createDataFrame([(1, 0, 10, 14, True), (2, 5, 5, 5, False)], "w long, first_s long, last_s long, review_s long, final boolean")
    got = {(r.w, r.at_s): r.role for r in W.window_samples(windows, 5).collect()}
    assert got == {(1, t): "stable_candidate" if t >= 4 else "process_scan" for t in (0, 5, 6, 8, 10, 12, 14)} | {(2, 5): "process_scan"}
    rows = spark.createDataFrame([(e, i, (i * 7) % 10, None if i == 3 else (i * 3) % 10) for e, n in ((1, 3), (2, 9)) for i in range(n)], "entity long, i long, m long, s long")
    got = W.mandatory_picks(rows, ["entity"], ["i"], "m", "s", 4).groupBy("entity").agg(F.sort_array(F.collect_list("i")).alias("l")).collect()
    # the spread is 0, 3, 5, 8; 7, the best by motion, takes the place of 3, and 6, the best by sharpness, that of 7
    assert {r.entity: r.l for r in got} == {1: [0, 1, 2], 2: [0, 5, 6, 8]}
