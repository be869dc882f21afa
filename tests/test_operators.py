"""Order-dependent operators, text functions, sources and streams against plain versions."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.operators import checking, decode, intervals, matching, sampling, voting
from chronoweave.sources import timeline as S
from chronoweave.streaming import live

SCHEMA = "event_id long, entity long, action string, first_s long, last_s long, conf long"


def events(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        t = rng.randrange(0, 20000)
        data.append((i, rng.randrange(6), rng.choice(["wiring", "measurement", "writing", "cleanup", "uncertain"]), t, t + rng.randrange(0, 400), rng.randrange(0, 1000)))
    return data, spark.createDataFrame(data, SCHEMA)


def by_entity(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[3], r[4], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_overlap_merge_as_a_loop(spark):
    data, df = events(spark)
    want = []
    for entity, rows in by_entity(data).items():
        for action in {r[2] for r in rows}:
            now = None
            for r in (r for r in rows if r[2] == action):
                if now and r[3] <= now[1]:
                    now[1] = max(now[1], r[4])
                    if r[5] > now[2]:
                        now[2], now[3] = r[5], r[0]
                    now[4] += 1
                else:
                    now = [r[3], r[4], r[5], r[0], 1]
                    want.append((entity, action, now))
    want = sorted((e, a, *n) for e, a, n in want)
    got = sorted((r.entity, r.action, r.first_s, r.last_s, r.conf, r.event_id, r.members) for r in intervals.merge_overlaps(df).collect())
    assert got == want


def test_state_machine_as_a_loop(spark):
    data, df = events(spark)
    got = {r.event_id: (r.stage, r.phase) for r in decode.state_machine(df, decode.SEVEN, 6).collect()}
    for rows in by_entity(data).values():
        rows = sorted(rows, key=lambda r: (r[3], r[0]))
        last = [r[0] for r in rows if r[2] == "cleanup"][-1:]
        phase = 0
        for r in rows:
            stage, phase_now = got[r[0]]
            assert phase_now >= phase or stage in ("circuit_rewiring", "measurement_2", "noise", None)
            phase = phase_now
            if [r[0]] == last:
                assert stage == "material_cleanup" and phase == 6
    pair = spark.createDataFrame([(1, 1, "wiring", 0, 1, 1), (2, 1, "measurement", 2, 3, 1), (3, 1, "writing", 4, 5, 1), (4, 1, "wiring", 6, 7, 1), (5, 1, "measurement", 8, 9, 1), (6, 1, "writing", 10, 11, 1), (7, 1, "cleanup", 12, 13, 1), (8, 1, "wiring", 14, 15, 1)], SCHEMA)
    assert [r.stage for r in decode.state_machine(pair, decode.SEVEN, 6).orderBy("event_id").collect()] == ["circuit_wiring", "measurement_1", "recording_1", "circuit_rewiring", "measurement_2", "recording_2", "material_cleanup", "noise"]
    assert [r.stage for r in decode.state_machine(pair, decode.FIVE, 4).orderBy("event_id").collect()] == ["circuit_wiring", "recording_1", "recording_1", "circuit_rewiring", "recording_2", "recording_2", "material_cleanup", "noise"]


def test_greedy_conflicts(spark):
    rows = spark.createDataFrame([(1, 1, "wiring", 0, 10, 500), (2, 1, "measurement", 5, 15, 900), (3, 1, "writing", 20, 30, 700), (4, 1, "wiring", 25, 35, 700), (5, 1, "uncertain", 0, 99, 999), (6, 1, "writing", 90, 95, 1)], SCHEMA)
    assert {r.event_id for r in decode.greedy_conflicts(rows).where("kept").collect()} == {2, 5, 6}
    assert {r.event_id for r in decode.greedy_conflicts(rows, preserve_ties=True).where("kept").collect()} == {2, 3, 5, 6}


def test_picks(spark):
    data, df = events(spark)
    kept = decode.separated(df, "first_s", "conf", 500, 5).collect()
    for rows in by_entity(data).values():
        mine = sorted((r.first_s for r in kept if r.entity == rows[0][1]))
        assert len(mine) <= 5 and all(b - a >= 500 for a, b in zip(mine, mine[1:]))
        best = max(rows, key=lambda r: (r[5], -r[3], -r[0]))
        assert best[3] in mine
    assert {r.c for r in sampling.uniform_pick(df, ["first_s", "event_id"], 5).groupBy("entity").agg(F.count("*").alias("c")).collect()} == {5}
    order = {r.event_id: r.rank for r in decode.farthest_first(df.where("entity = 1"), "first_s").collect()}
    mine = by_entity(data)[1]
    first, second = sorted(order, key=order.get)[:2]
    assert first == mine[0][0] and second == max(mine, key=lambda r: (r[3], -r[0]))[0]


def test_two_means_and_hysteresis(spark):
    low, high = decode.two_means(pd.Series([0.1, 0.12, 0.9, 0.88]).to_numpy())
    assert abs(low - 0.11) < 1e-9 and abs(high - 0.89) < 1e-9
    rows = [(i, 1, "x", i, i, c) for i, c in enumerate([0, 0, 900, 0, 900, 900, 500, 900, 0, 0, 0])]
    got = decode.hysteresis(spark.createDataFrame(rows, SCHEMA), "conf", ["first_s"]).orderBy("event_id").collect()
    assert [r.state for r in got] == ["absent"] * 5 + ["present"] * 4 + ["absent"] * 2


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 20.0, 30.0, 30.0, 0.1)]
    got = decode.suppressed(spark.createDataFrame(rows, "entity long, event_id long, x0 double, y0 double, x1 double, y1 double, score double"), 5).collect()
    assert {r.event_id for r in got} == {1, 3}


def test_gate_leaves_missing_prerequisites_alone(spark):
    results = spark.createDataFrame([(1, "pass"), (2, "pass"), (3, "fail")], "entity long, decision string")
    before = spark.createDataFrame([(1, "fail"), (1, "pass"), (3, "pass")], "entity long, decision string")
    assert {r.entity: r.gated for r in voting.gate(results, before).collect()} == {1: "fail", 2: "pass", 3: "fail"}


def test_text_functions(spark):
    rows = spark.createDataFrame([("a/b/42_clip.mp4", "there is no spark. then a spark", "```json\n{\"a\": 1}\n```", "about 3,5 V", 3725), ("x/My File.v2.mov", "without any spark", "none", "none", 59)], "name string, t string, j string, v string, s long")
    got = rows.select(X.entity_id(F.col("name")).alias("id"), X.mentions(F.col("t"), "spark", 14).alias("m"), F.expr("1").alias("one"), X.fenced_json("j").cast("string").alias("j"), X.first_decimal("v").alias("v"), X.clock("s").alias("c"), X.slug(F.lit("A b-C ")).alias("g"), X.redacted(F.lit("token = \"abcdefgh12\" at 10.0.0.1")).alias("r"), X.angular_distance(F.lit(350.0), F.lit(10.0)).alias("d")).collect()
    assert [r.id for r in got] == ["42", "My_File_v2"] and [r.m for r in got] == [True, False] and [r.v for r in got] == [3.5, None]
    assert got[0].j == '{"a":1}' and got[1].j is None and [r.c for r in got] == ["1:02:05", "0:00:59"] and got[0].g == "a_b_c" and got[0].r == "token = [redacted] at [address]" and got[0].d == 20.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"runs": [{"stage": "x", "start_seconds": 1, "end_seconds": 2, "note": "n"}, {"stage": "x", "start_seconds": 1, "end_seconds": 2}], "deep": {"more": [{"stage": "y", "start_seconds": 3.5, "end_seconds": 4}]}}))
    (tmp_path / "b.json").write_text("not json")
    docs = S.read_documents(spark, str(tmp_path / "*.json"))
    got = sorted((r.stage, r.start_s, r.end_s, r.fields) for r in S.nested_runs(docs).collect())
    assert got == [("x", 1.0, 2.0, 4), ("y", 3.5, 4.0, 3)]
    run = str(tmp_path / "run")
    S.write_run(spark.range(3).toDF("n"), run)
    try:
        S.write_run(spark.range(3).toDF("n"), run)
    except Exception as e:  # noqa: BLE001
        assert "EXISTS" in str(e).upper()
    else:
        raise AssertionError("an existing run was overwritten")
    lines = [r.line for r in S.table_lines(spark.createDataFrame([(2, None), (1, "p")], "k int, v string"), "k", ["k", "v"]).orderBy("n").collect()]
    assert lines == ["| k | v |", "|---|---|", "| 1 | p |", "| 2 |  |"]
    (tmp_path / "c.MP4").write_bytes(b"abc")
    assert [r.length for r in S.media_files(spark, str(tmp_path)).collect()] == [3]
    files = spark.read.format("binaryFile").load(str(tmp_path / "c.MP4"))
    assert S.manifest(files).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_matching_on_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, 15), (2, 5)], "entity long, t long")
    right = spark.createDataFrame([(1, 10, 7), (1, 20, 8), (1, 10, 6), (3, 1, 1)], "entity long, t long, v long")
    got = sorted((r.entity, r.t, r.v_near, r.distance) for r in matching.nearest(left, right, "t", "v").collect() if r.entity == 1)
    assert got == [(1, 10, 6, 0), (1, 15, 6, 5)]
    assert {(r.entity, r.t): r.v_asof for r in matching.asof(left, right, "t", "v").collect()} == {(1, 10): 7, (1, 15): 7, (2, 5): None}
    assert {(r.entity, r.t): r.v_asof for r in matching.asof(left, right, "t", "v", strict=True).collect()}[1, 10] is None


def test_contracts(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    got = {r.k: r.errors for r in checking.errors(rows, {"null": F.col("v").isNotNull(), "negative": F.col("v") >= 0}).collect()}
    assert got == {1: [], 2: ["null", "negative"], 3: ["negative"]}


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = tmp_path / "in"
    spark.read.parquet(source).repartition(2).write.parquet(str(folder))
    batch = spark.read.parquet(source)
    for name, f in {"tumbling": live.tumbling_counts, "sliding": live.sliding_counts, "sessions": live.sessions}.items():
        stream = f(spark.readStream.schema(schema).parquet(str(folder)))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0
    last = batch.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("ts") < F.lit(last) - F.expr("interval 1 hour")).count()
    assert closed - 20 <= spark.table("tumbling").agg(F.sum("events")).first()[0] <= batch.count()


def test_beam_keeps_the_plain_protocol(spark):
    names = ["wiring", "measurement", "writing", "wiring", "measurement", "writing", "cleanup", "wiring"]
    rows = spark.createDataFrame([(i, 1, a, 40 * i, 40 * i + 20, 900) for i, a in enumerate(names)], SCHEMA)
    got = [r.stage for r in decode.beam_decode(rows).orderBy("event_id").collect()]
    assert got == ["circuit_wiring", "measurement_1", "recording_1", "circuit_rewiring", "measurement_2", "recording_2", "material_cleanup", "noise"]
    # wiring after a measurement: a correction if that was short and another follows, a rewiring if it was long
    fix = spark.createDataFrame([(1, 1, "wiring", 0, 5, 500), (2, 1, "measurement", 10, 11, 500), (3, 1, "wiring", 12, 15, 500), (4, 1, "measurement", 16, 30, 500), (5, 1, "writing", 40, 50, 500)], SCHEMA)
    assert [r.stage for r in decode.beam_decode(fix).orderBy("event_id").collect()] == ["circuit_wiring", "measurement_1", "circuit_wiring", "measurement_1", "recording_1"]


def test_tracks_follow_boxes(spark):
    rows = [(1, 10 * f + k, f, 50.0 * k + f, 0.0, 50.0 * k + f + 20, 20.0) for f in range(4) for k in range(2)]
    got = decode.linked_tracks(spark.createDataFrame(rows, "entity long, event_id long, frame long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r.event_id: r.track for r in got} == {10 * f + k: k for f in range(4) for k in range(2)}
