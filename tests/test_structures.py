"""Tracking, pairs in the plane, requests, nested values, artifact rules and the gate against plain Python."""

import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import folds, gate, graph, nested, requests, tracking


def test_gap_groups(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, 9), (2, 4, 100), (None, 5, 1), (None, 6, 2)], "entity long, event_id long, at long")
    assert {r.event_id: r.group_no for r in tracking.gap_groups(rows, "at", 3).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


def candidates(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.randrange(3), rng.randrange(25), i, rng.randrange(160), rng.randrange(160), rng.choice([*range(200, 1000, 20), 700, 700]), rng.randrange(1000)) for i in range(n)]


def track_loop(rows, limits):
    """One group's track, step by step as the protocol has it."""
    frames = {}
    for r in rows:
        frames.setdefault(r[2], []).append(r)
    for c in frames.values():
        c.sort(key=lambda r: (-r[6], r[3]))
    order = sorted(frames)
    anchor = min((r for r in rows), key=lambda r: (-r[6], r[2], r[3]))
    out = [(anchor, 0.0)]
    for path in ([f for f in order if f > anchor[2]], [f for f in reversed(order) if f < anchor[2]]):
        last = anchor
        for f in path:
            near = [(r[6] / 1000 - g / limits.per_pixel, g, r) for r in frames[f] if (g := math.hypot(r[4] - last[4], r[5] - last[5])) <= limits.reach]
            if near:
                _, g, best = max(near, key=lambda x: x[0])
                if best[6] >= limits.least and best[7] >= limits.least_alike:
                    out.append((best, g))
                    last = best
    return {(r[0], r[1], r[2], r[3]) for r, g in out if not (r[6] < limits.weak and g > limits.near) and (r[6] >= limits.sure or (r[6] >= limits.weak and r[7] >= limits.alike))}


def test_tracks_out_from_the_anchor(spark):
    data = candidates()
    limits = tracking.Limits(reach=60.0, per_pixel=90.0)
    df = spark.createDataFrame([*data, (9, 9, 1, 9000, None, 1, 999, 999)], "entity long, group_no long, frame long, event_id long, x long, y long, score long, alike long").repartition(3)
    want = set()
    for key in {r[:2] for r in data}:
        want |= track_loop([r for r in data if r[:2] == key], limits)
    got = {(r.entity, r.group_no, r.frame, r.event_id) for r in tracking.tracked_outwards(df, limits).collect()}
    assert got == want and len(want) > 40
    assert tracking.tracked_outwards(df.where("false")).collect() == []


def test_a_fold_keeps_nothing_of_a_long_key(spark):
    class Last(folds.Fold):
        def __init__(self):
            self.n, self.last = 0, None

        def row(self, r):
            assert self.last is None or r["at"] >= self.last
            self.n, self.last = self.n + 1, r["at"]
            return []

        def end(self):
            return [(self.n, self.last)]

    rows = spark.range(30000).selectExpr("if(id < 20000, null, id % 3) as k", "id * 7919 % 30011 as at")
    got = folds.folded(rows, ["k"], ["at"], Last, "n long, last long").collect()
    assert sorted(r.n for r in got) == [3333, 3333, 3334, 20000]


@pytest.mark.parametrize("levels", [1, 4])
def test_nearest_in_plane_and_apart(spark, levels):
    rng = random.Random(levels)
    point = lambda i: (i, rng.randrange(2), rng.randrange(-300, 300), rng.randrange(-300, 300), rng.randrange(0, 4000), rng.randrange(100))
    a, b = [point(i) for i in range(150)], [point(1000 + i) for i in range(150)]
    b += [(2000 + i, 0, 5, 5, 50, 1) for i in range(60)]  # a dense place
    schema = "event_id long, k long, x long, y long, at long, q long"
    left, right = spark.createDataFrame([*a, (9000, 0, None, 1, 1, 1)], schema), spark.createDataFrame([*b, (9001, 0, 1, None, 1, 1)], schema)
    want = set()
    for i, k, x, y, *_ in a:
        near = [((x - p) ** 2 + (y - q) ** 2, j) for j, m, p, q, *_ in b if m == k]
        d, j = min(near, default=(1e9, 0))
        if d <= 80 * 80:
            want.add((k, i, j, d))
    assert {tuple(r) for r in tracking.nearest_in_plane(left, right, ["k"], "event_id", 80, levels=levels).collect()} == want
    best = {}
    for i, k, x, y, t, q in a:
        for j, m, p, r, u, s in b:
            if m == k and abs(t - u) <= 900 and (x - p) ** 2 + (y - r) ** 2 >= 100**2:
                best[k] = min(best.get(k, (1e9,)), (abs(t - u), -(q + s), i, j))
    got = {r.k: (r.gap, -r.quality, r.left_id, r.right_id) for r in tracking.nearest_apart(left, right, ["k"], "event_id", "at", 900, 100, "q", levels=levels).collect()}
    assert got == best


def test_collisions(spark):
    box = lambda x, s: (float(x), 0.0, float(x + 10), 10.0, s)
    rows = [(1, box(0, 9), box(1, 3)), (2, box(0, 9), box(1, 8)), (3, box(0, 9), box(30, 9)), (4, box(30, 9), box(0, 9)), (5, None, box(0, 9)), (6, box(0, 5), box(0, 0)), (7, box(0, 3), box(1, 9))]
    shape = "struct<x0: double, y0: double, x1: double, y1: double, s: int>"
    got = tracking.resolved_collisions(spark.createDataFrame(rows, f"i int, a {shape}, b {shape}"), "a", "b", "s", overlap=0.35, ratio=1.25)
    assert {r.i: (r.reason, r.a_kept, r.b_kept) for r in got.collect()} == {1: ("weaker", True, False), 2: ("ambiguous", False, False), 3: (None, True, True), 4: ("order", False, False), 5: (None, False, True), 6: ("ambiguous", False, False), 7: ("weaker", False, True)}


# ---- requests


def test_diverse_picks(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), i, rng.choice([0.25, 0.5, rng.random()]), rng.sample("abcd", rng.randrange(3)) if i % 9 else None, rng.choice(["s", "t", None]), rng.randrange(50)) for i in range(200)]
    rows += [(1, 900, None, [], "s", 1), (None, 901, 0.5, ["a"], "s", 1), (None, 902, 0.45, ["b"], "s", 1), (None, 903, 0.49, ["a"], "s", 2)]
    want = set()
    for key in {r[0] for r in rows}:
        left, seen, had = [r for r in rows if r[0] == key and r[2] is not None], set(), set()
        for pick in range(1, 5):
            if not left:
                break
            gain = lambda r: r[2] + (0.18 if not r[3] or set(r[3]) - seen else 0.0) + (0.0 if r[4] in had else 0.08)  # noqa: E731, B023
            best = min(left, key=lambda r: (-gain(r), r[5], r[1]))  # noqa: B023
            want.add((key, pick, best[1]))
            left.remove(best)
            seen |= set(best[3] or [])
            had.add(best[4])
    df = spark.createDataFrame(rows, "entity long, id long, score double, tracks array<string>, source string, at long")
    got = {(r.entity, r.pick, r.id) for r in requests.diverse_picks(df, ["entity"], "id", "score", "tracks", "source", [F.col("at")]).collect()}
    assert got == want


def best_window(points, known, barred, budget, anchor):
    """All stretches of a list of times, as the protocol scores them."""
    best, points = None, sorted(points)
    for i in range(len(points)):
        for j in range(i, len(points)):
            part = points[i : j + 1]
            new = [p for p in part if p not in known]
            if any(p in barred for p in part) or not new or len(new) > budget:
                continue
            score = (len(new), len(part), -abs(part[0] + part[-1] - 2 * anchor), -part[0])
            if best is None or score > best[0]:
                best = (score, part)
    return best and best[1]


def test_fitted_windows_and_plans(spark):
    rng = random.Random(8)
    points, want = [], {}
    for k in range(40):
        times = rng.sample(range(60), rng.randrange(1, 20))
        known, barred = {t for t in times if rng.random() < 0.4}, {t for t in times if rng.random() < 0.15}
        budget, anchor = rng.randrange(0, 8), rng.randrange(60)
        points += [(k, t, t in known, t in barred, budget, anchor) for t in times]
        if part := best_window(times, known, barred, budget, anchor):
            want[k] = (part[0], part[-1], len(part), len([t for t in part if t not in known]))
    df = spark.createDataFrame([*points, *points[:30]], "entity long, at long, known boolean, barred boolean, budget long, anchor long")
    assert {r.entity: tuple(r)[1:] for r in requests.fitted_windows(df, ["entity"], "at").collect()} == want

    anchors = [(e, k, a, a - a % 5 - 20, a - a % 5 + 20) for e in range(12) for k, a in enumerate(rng.sample(range(200), 5), 1)]
    known = [(e, t) for e in range(12) for t in range(-20, 230, 5) if rng.random() < 0.5]
    want = set()
    for e in range(12):
        have, taken, left, made = {t for x, t in known if x == e}, set(), 9, 0
        for _, k, at, low, high in [a for a in anchors if a[0] == e]:
            if made < 3 and left > 0 and (part := best_window(range(low, high + 1, 5), have | taken, taken, left, at)):
                made, new = made + 1, [t for t in part if t not in have | taken]
                want.add((e, made, k, part[0], part[-1], len(part), len(new)))
                left, taken = left - len(new), taken | set(part)
    got = requests.request_plan(spark.createDataFrame(anchors, "entity long, rank long, at long, low long, high long"), spark.createDataFrame(known, "entity long, at long"), step=5, budget=9)
    assert {tuple(r) for r in got.collect()} == want and len({w[1] for w in want}) == 3


def test_checked_requests(spark):
    stages = [(1, 10.0, 20.0), (1, 30.0, 31.0), (2, 5.0, 6.0)]
    cases = {1: ([(9.0, 12.0)], None), 2: ([], "number_of_ranges"), 3: (None, "number_of_ranges"), 4: ([(10.0, 11.0)] * 4, "number_of_ranges"), 5: ([(10.0, 14.5)], "too_long"), 6: ([(18.0, 22.0)], None), 7: ([(18.0, 22.1)], "too_long"), 8: ([(19.0, 22.5)], "outside_stages"), 9: ([(10.0, 14.0), (11.0, 15.0), (12.0, 13.0)], "too_long_together"), 10: ([(12.0, 12.0)], "outside_video"), 11: ([(10.0, None)], "not_a_number"), 12: ([(float("nan"), 3.0)], "not_a_number"), 13: ([(99.0, 101.0)], "outside_video"), 14: ([(10.0, 11.0), (50.0, 51.0), (5.0, 1.0)], "outside_stages"), 15: ([(28.0, 32.0), (10.0, 14.0)], None)}
    rows = [(1, i, r, 100) for i, (r, _) in cases.items()] + [(3, 99, [(1.0, 2.0)], 100)]
    got = requests.checked_requests(spark.createDataFrame(rows, "entity long, id long, ranges array<struct<start: double, end: double>>, duration int"), spark.createDataFrame(stages, "entity long, start double, end double"), "id")
    assert {r.id: r.error for r in got.collect()} == {i: e for i, (_, e) in cases.items()} | {99: "no_stages"}


# ---- nested values


def redact(value):
    if isinstance(value, dict):
        return {k: nested.MARK if re.search(nested.SECRET_KEY, k) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) for v in value]
    return re.sub(nested.SECRET_VALUE, nested.MARK, value) if isinstance(value, str) else value


def made_up(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind > 4:
        return {rng.choice(["a", "b.c", "token", 'q"uote', "x\x01y", "é", "API-Key", "video_3", "VIDEO_12_x", "fixed_roi", ""]) + (str(i) if rng.random() < 0.3 else ""): made_up(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == 4:
        return [made_up(rng, depth + 1) for _ in range(rng.randrange(12 if depth == 1 else 4))]
    return rng.choice([None, True, 12, -3, "plain", "bearer abcdefgh12", "xx sk-ABCDEFGH1 yy", "tab\t\"q\"", "", "é"])


def test_nested_values_are_redacted_and_put_together(spark):
    rng = random.Random(11)
    documents = [made_up(rng) for _ in range(40)] + [{"deep": [[[[{"secret": {"a": [1, 2]}}]]]]}, [], {}, "sk-12345678", 5, {"token": None}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(documents)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, body string").select("id", F.parse_json("body").alias("root"))
    got = {r.id: json.loads(r.body) for r in nested.redacted_documents(df, "id", "root").collect()}
    assert got == {i: redact(v) for i, v in enumerate(documents)}
    plain = {r.id: json.loads(r.body) for r in nested.put_together(nested.taken_apart(df, "id", "root")).collect()}
    assert plain == dict(enumerate(documents))

    def bad(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                if k == "fixed_roi" or re.fullmatch(r"video_\d+(?:_.+)?", k, flags=re.I):
                    yield ".".join([*path, k])
                yield from bad(v, [*path, k])
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from bad(v, [*path, str(i)])

    want = sorted((i, p) for i, v in enumerate(documents) for p in bad(v, ["workflow"]))
    assert sorted(map(tuple, nested.forbidden_paths(df, "id", "root", ["fixed_roi"], root="workflow").collect())) == want and len(want) > 3
    assert nested.redacted_documents(df.where("false"), "id", "root").collect() == []


# ---- producers, artifacts and the gate


def test_producer_plan(spark):
    made = spark.createDataFrame([("b", 1, 5), ("b", 2, 1), ("a", 2, 2), ("c", 9, 0), ("b", 1, 7), (None, 1, 0), ("d", None, 0), ("e", 3, 2)], "tool string, produced long, pos long")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,), (77,)], "produced long")
    assert sorted(map(tuple, graph.producer_plan(made, wanted).select("call_no", "tool", "products", "wanted", "first_product").collect())) == [(1, "b", 2, 2, 1), (2, "a", 1, 1, 2), (3, "e", 1, 1, 3)]


def test_artifact_rules(spark):
    cases = [
        ("validation_gate", {"rubric_id": 1, "status": "open", "frozen_artifacts": [], "required_new_data": [], "prohibited_actions": []}, []),
        ("validation_gate", {"rubric_id": 1, "status": "blocked_waiting_for_data", "frozen_artifacts": [{"path": "p", "sha256": "0" * 64}, {"path": "p"}], "required_new_data": [1], "prohibited_actions": [1]}, ["INVALID_FROZEN_ARTIFACT"]),
        ("validation_gate", None, ["JSON_PARSE_ERROR"]),
        ("validation_gate", [1], ["INVALID_ROOT_TYPE"]),
        (None, {}, ["UNKNOWN_ARTIFACT_TYPE"]),
        ("offline_evaluation", {"prediction_package_path": "p", "prediction_package_sha256": "F" * 64, "prediction_frozen_before_ground_truth": "true"}, ["PREDICTION_NOT_FROZEN_BEFORE_GROUND_TRUTH"]),
        ("qwen_structured_result", {"json_parsed": True, "safety_valid": True, "result": {}, "validation_errors": []}, []),
        ("prediction_package", {"rubric_id": 1, "source_video": "v", "automated_decision": "yes", "automated_outcome": "scored", "score": 1, "circuit_closed_evidence": {}}, []),
        ("prediction_package", {"rubric_id": 1, "source_video": None, "automated_decision": "yes", "automated_outcome": "scored", "score": 7}, ["MISSING_REQUIRED_FIELD", "MISSING_CIRCUIT_EVIDENCE", "SCORED_OUTCOME_INVALID_SCORE"]),
    ]
    rows = [(i, t, None if v is None else "﻿" + json.dumps(v)) for i, (t, v, _) in enumerate(cases)]
    got = gate.checked_artifacts(spark.createDataFrame(rows, "i long, t string, b string"), "t", "b")
    assert {r.i: sorted(r.errors) for r in got.collect()} == {i: sorted(e) for i, (*_, e) in enumerate(cases)}
    assert got.columns == ["i", "t", "b", "errors"]


def test_the_gate_opens_and_stays_shut(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(20).select("id", F.when(F.col("id") < 2, F.array(F.lit("INVALID_FRAMES"))).otherwise(F.array().cast("array<string>")).alias("errors")).repartition(3)
    assert gate.gated_write(rows, path, "strict")[0] is False
    assert os.listdir(path) == []
    opened, counts = gate.gated_write(rows, path, "lenient", most=0.1)
    assert opened and (counts["rows"], counts["wrong"], counts["INVALID_FRAMES"]) == (20, 2, 2)
    assert [f for f in os.listdir(path) if not f.endswith(".crc")] == ["lenient"] and spark.read.parquet(f"{path}/lenient").count() == 20
    with pytest.raises(FileExistsError):
        gate.gated_write(rows, path, "lenient", most=1.0)
    assert gate.gated_write(rows.where("false"), path, "empty")[0] is True
