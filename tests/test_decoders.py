"""Decoders without SQL against plain loops over whole tables."""

import itertools
import statistics
from collections import defaultdict

import pytest

from chronoweave.operators import decode
from chronoweave.plans import registry
from chronoweave.plans.queries import tl
from chronoweave.sources.timeline import nested_numbers, nested_runs, read_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    by = defaultdict(list)
    for r in tl(spark, SF).collect():
        by[r.entity].append(r)
    return {k: sorted(v, key=lambda r: (r.first_s, r.event_id)) for k, v in by.items()}


def result(spark, name, *columns):
    return {r.event_id: tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, SF).collect()}


def test_hysteresis(spark, events):
    want = {}
    for rows in events.values():
        x = [r.conf for r in rows]
        low, high = float(min(x)), float(max(x))
        for _ in range(20):
            a = [v for v in x if v <= (low + high) / 2]
            b = [v for v in x if v > (low + high) / 2]
            was, low, high = (low, high), (statistics.fmean(a) if a else low), (statistics.fmean(b) if b else high)
            if abs(was[0] - low) + abs(was[1] - high) < 1e-8:
                break
        apart = high - low >= max(0.025, 0.08 * max(high, 1e-6))
        down, up = (low + 0.35 * (high - low), low + 0.65 * (high - low)) if apart else (statistics.median(x),) * 2
        on, run = x[0] >= (down + up) / 2, 0
        for i, r in enumerate(rows):
            if i:
                run = run + 1 if (r.conf <= down if on else r.conf >= up) else 0
                if run >= 2:
                    on, run = not on, 0
            want[r.event_id] = ("present" if on else "absent",)
    assert result(spark, "hysteresis", "state") == want


def test_hysteresis_of_alike_values(spark):
    rows = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([5, 5, 5, 5])], "entity string, event_id long, first_s long, conf long")
    assert [r.state for r in decode.hysteresis(rows, "conf", ["first_s"]).orderBy("event_id").collect()] == ["present", "present", "absent", "absent"]


@pytest.mark.parametrize("ties", [False, True])
def test_greedy_conflicts(spark, events, ties):
    want = {}
    for rows in events.values():
        kept = {}
        for e in rows:
            foes = [k for k in kept.values() if "uncertain" not in (e.action, k.action) and k.action != e.action and k.first_s <= e.last_s and e.first_s <= k.last_s]
            all_ = [*foes, e]
            best = [x for x in all_ if x.conf == max(y.conf for y in all_)]
            if ties:
                best = sorted(best, key=lambda x: (x.last_s - x.first_s, x.first_s, x.event_id))[:1]
            for x in all_:
                kept.pop(x.event_id, None)
            if len(best) == 1:
                kept[best[0].event_id] = best[0]
        want |= {e.event_id: e.event_id in kept for e in rows}
    got = {r.event_id: r.kept for r in decode.greedy_conflicts(tl(spark, SF), ties).collect()}
    assert got == want and not all(want.values())


def test_farthest_first(spark, events):
    want = {}
    for rows in events.values():
        left, done = list(rows), []
        while left:
            pick = max(left, key=lambda r: (min((abs(r.first_s - x.first_s) for x in done), default=-r.first_s), -r.first_s, -r.event_id))
            left.remove(pick)
            done.append(pick)
        want |= {r.event_id: (i,) for i, r in enumerate(done, 1)}
    assert result(spark, "farthest_first", "rank") == want


def overlap(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def test_suppression(spark, events):
    want = set()
    for rows in events.values():
        boxes, kept = sorted(rows, key=lambda r: (-r.conf, r.event_id)), []
        for r in boxes:
            box = (r.first_s / 1e4, r.conf / 1e2, r.last_s / 1e4, r.conf / 1e2 + 5)
            if len(kept) < 20 and (r.last_s > r.first_s) and all(overlap(box, k) < 0.35 for k in kept):
                kept.append(box)
                want.add(r.event_id)
    assert set(result(spark, "nms_iou")) >= want and len(want) > 100


def test_tracks(spark, events):
    want = {}
    for rows in events.values():
        tracks = []  # [frame, box, ids]
        frames = itertools.groupby(rows, key=lambda r: r.first_s // 86400)
        for frame, now in frames:
            now = sorted(now, key=lambda r: r.event_id)
            box = {r.event_id: (r.first_s % 86400 / 1e3, r.conf / 1e2, r.first_s % 86400 / 1e3 + 30, r.conf / 1e2 + 5) for r in now}
            pairs = sorted((-overlap(t[1], box[r.event_id]), k, i) for k, t in enumerate(tracks) if frame - t[0] <= 2 for i, r in enumerate(now))
            used, given = set(), set()
            for cost, k, i in pairs:
                if -cost >= 0.25 and k not in used and i not in given:
                    used.add(k)
                    given.add(i)
                    tracks[k] = [frame, box[now[i].event_id]]
                    want[now[i].event_id] = (k,)
            for i, r in enumerate(now):
                if i not in given:
                    want[r.event_id] = (len(tracks),)
                    tracks.append([frame, box[r.event_id]])
    assert result(spark, "track_link", "track") == want


def test_beam_is_exact_where_it_is_wide(spark):
    """Against every path, on short sequences; a wide beam keeps the best of each state."""
    kinds = ["wiring", "measurement", "writing", "cleanup", "uncertain"]
    rows = []
    for n, seq in enumerate([(0, 1, 0, 2, 1, 2, 3), (1, 0, 1, 0, 2, 1, 2), (0, 1, 0, 0, 1, 2, 2, 1, 2), (4, 1, 3, 2, 0, 3, 1), (2, 2, 0, 2, 1, 1, 2)]):
        rows += [(f"e{n}", 100 * n + i, kinds[k], 10 * i, 10 * i + 3 + i, 100 * (i + n) % 1000) for i, k in enumerate(seq)]
    df = spark.createDataFrame(rows, "entity string, event_id long, action string, first_s long, last_s long, conf long")
    got = {r.entity: r.score for r in decode.beam_decode(df, width=1000).collect()}
    for name in got:
        mine = [r for r in df.orderBy("first_s").collect() if r.entity == name]
        ends = [i for i, r in enumerate(mine) if r.action == "cleanup"]
        paths = [decode.Guess()]
        for i, e in enumerate(mine):
            soon = {a: any(x.action == a and x.first_s - e.last_s <= 30 for x in mine[i + 1 :]) for a in ("measurement", "writing")}
            paths = [new for g in paths for new in decode.options(g, e, bool(ends) and i == ends[-1], soon, 1)]
        assert got[name] == pytest.approx(max(p.score for p in paths))
    narrow = {r.entity: r.score for r in decode.beam_decode(df, width=2).collect()}
    assert all(narrow[k] <= got[k] + 1e-9 for k in got)


def test_beam_by_hand(spark):
    rows = [("a", 1, "wiring", 0, 5, 500, None), ("a", 2, "measurement", 10, 20, 1000, None), ("a", 3, "wiring", 30, 31, 0, "重新插好"), ("a", 4, "measurement", 40, 50, 0, None), ("a", 5, "writing", 60, 70, 0, None), ("a", 6, "cleanup", 80, 90, 1000, None), ("a", 7, "wiring", 95, 96, 0, None)]
    df = spark.createDataFrame(rows, "entity string, event_id long, action string, first_s long, last_s long, conf long, evidence string")
    got = sorted((r.event_id, r.stage, r.phase, r.score) for r in decode.beam_decode(df).collect())
    assert [s for _, s, _, _ in got] == ["circuit_wiring", "measurement_1", "circuit_wiring", "measurement_1", "recording_1", "material_cleanup", "noise"]
    short = 1 - 10 / 12
    assert got[0][3] == pytest.approx(0.55 + 0.1 + 0.7 + 0.2 + 0.2 + 0.35 * short + 0.45 + 0.2 + 0.7 + 0.75 + 1.2)
    back = [("b", 1, "measurement", 0, 5, 0, None), ("b", 2, "writing", 6, 9, 0, None), ("b", 3, "wiring", 10, 12, 0, None), ("b", 4, "measurement", 13, 15, 0, None), ("b", 5, "writing", 16, 19, 0, None), ("b", 6, "measurement", 20, 22, 1000, None), ("b", 7, "writing", 23, 25, 0, None)]
    got = sorted((r.event_id, r.stage, r.score) for r in decode.beam_decode(spark.createDataFrame(back, df.schema)).collect())
    assert [s for _, s, _ in got] == ["measurement_1", "recording_1", "circuit_rewiring", "measurement_2", "recording_2", "measurement_2", "recording_2"]
    assert got[0][2] == pytest.approx(0.7 + 0.75 + 0.8 + 0.8 + 0.8 - 0.25 + 0.1 + 0.7)


def test_nested_documents_of_any_depth(spark, tmp_path):
    deep = '{"stage": "s", "start_seconds": 1, "end_seconds": 2, "frame_number": 7, "note": "x"}'
    for _ in range(12):
        deep = '{"a": [' + deep + ', 3]}'
    (tmp_path / "a.json").write_text("\ufeff" + deep)
    (tmp_path / "b.json").write_text('[{"stage": "s", "start_seconds": 1, "end_seconds": 2}, {"x": {"stage": "s", "start_seconds": 1, "end_seconds": 2, "k": 1}, "frame_number": 9}]')
    docs = read_documents(spark, str(tmp_path))
    got = sorted((r.path[-6:], r.stage, r.start_s, r.end_s, r.fields) for r in nested_runs(docs).collect())
    assert got == [("a.json", "s", 1.0, 2.0, 5), ("b.json", "s", 1.0, 2.0, 4)]
    assert sorted(r.number for r in nested_numbers(docs).collect()) == [7, 9]
