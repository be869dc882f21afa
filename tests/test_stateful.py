"""State machines: in parallel over parts, live over streams in several orders, after a restart, and with late rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import clusters, decode, scan
from chronoweave.streaming import stateful

SCHEMA = "event_id long, entity long, action string, first_s long, last_s long, conf long"
NEAR = 500


def events(n=260, seed=1, hot=0.4):
    """Events of a few entities, one of which holds a good part of all; some at one second."""
    rng = random.Random(seed)
    kinds = ["wiring", "measurement", "writing", "uncertain", "auxiliary"] * 6 + ["cleanup"]
    return [(i, 0 if rng.random() < hot else rng.randrange(1, 6), rng.choice(kinds), t, t + 5, rng.randrange(0, 400)) for i in range(n) for t in [rng.randrange(0, 4000) // 3 * 3]]


def by_entity(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[3], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def machine_loop(data, last=False):
    """(stage, phase) by event, straight from the protocol."""
    out = {}
    for rows in by_entity(data).values():
        ends = [r[0] for r in rows if r[2] == "cleanup"]
        end = (ends[-1] if last else ends[0]) if ends else None
        phase, over = 0, False
        for r in rows:
            stage = None
            if over:
                stage = "noise"
            elif r[0] == end:
                stage, phase, over = "material_cleanup", 6, True
            elif r[2] == "wiring" and phase <= 3:
                stage, phase = ("circuit_wiring", 0) if phase == 0 else ("circuit_rewiring", 3)
            elif r[2] == "measurement" and phase in (0, 1, 3, 4):
                stage, phase = ("measurement_1", 1) if phase < 2 else ("measurement_2", 4)
            elif r[2] == "writing" and phase < 6:
                stage, phase = ("recording_1", 2) if phase < 3 else ("recording_2", 5)
            out[r[0]] = (stage, phase)
    return out


def presence_loop(data, down, up, persist):
    out = {}
    for rows in by_entity(data).values():
        on, streak = rows[0][5] >= (down + up) / 2, 0
        for i, r in enumerate(rows):
            if i:
                streak = streak + 1 if (r[5] <= down if on else r[5] >= up) else 0
                if streak >= persist:
                    on, streak = not on, 0
            out[r[0]] = on
    return out


def staged(rows):
    stage = scan.protocol_stage(decode.SEVEN, 6, F.col("symbol"), F.col("before"))
    return {r.event_id: (r.stage, r.phase) for r in rows.select("event_id", stage.alias("stage"), F.least("after", F.lit(6)).alias("phase")).collect()}


def first_end():
    return scan.protocol_symbol(F.col("action") == "cleanup")


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_parts_of_a_key_compose(spark, parts):
    """The same rows in one part or in parts of a few rows each."""
    data = events()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        got = scan.scanned(df, scan.protocol(decode.SEVEN, 6), first_end(), ["entity"], ["first_s", "event_id"])
        assert staged(got) == machine_loop(data)
        for down, up, persist in ((100, 200, 3), (150, 150, 2), (100, 300, 1)):
            symbol = scan.persistence_symbol(F.col("conf"), F.lit(down), F.lit(up))
            got = scan.scanned(df, scan.persistence(persist), symbol, ["entity"], ["first_s", "event_id"]).collect()
            assert {r.event_id: r.after >= persist for r in got} == presence_loop(data, down, up, persist)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_keys_null_symbols_and_no_rows(spark):
    data = [(1, None, "wiring", 1, 1, 0), (2, None, "measurement", 2, 2, 0), (3, 7, None, 1, 1, 0), (4, 7, "wiring", 2, 2, 0)]
    got = scan.scanned(spark.createDataFrame(data, SCHEMA), scan.protocol(decode.SEVEN, 6), first_end(), ["entity"], ["first_s", "event_id"])
    assert staged(got) == {1: ("circuit_wiring", 0), 2: ("measurement_1", 1), 3: (None, 0), 4: ("circuit_wiring", 0)}
    assert scan.scanned(spark.createDataFrame([], SCHEMA), scan.persistence(2), F.lit(1), ["entity"], ["first_s"]).collect() == []


@pytest.mark.parametrize("order", ["sorted", "jitter"])
def test_a_replay_in_any_order_gives_the_batch_rows(spark, order):
    data = events(seed=3)
    rng = random.Random(order)
    moved = [(*r, r[3] + (0 if order == "sorted" else rng.randrange(0, NEAR))) for r in data]
    rows = spark.createDataFrame(moved, SCHEMA + ", arrival long")
    got = stateful.replayed(spark, rows, scan.protocol(decode.SEVEN, 6), first_end(), arrival=F.col("arrival"), late_s=NEAR, files=3)
    assert staged(got) == machine_loop(data)


def test_presence_live(spark):
    data = events(seed=4)
    symbol = scan.persistence_symbol(F.col("conf"), F.lit(100), F.lit(250))
    got = stateful.replayed(spark, spark.createDataFrame(data, SCHEMA), scan.persistence(2), symbol, arrival=F.col("first_s") + F.col("event_id") * 37 % NEAR, late_s=NEAR, files=2)
    assert {r.event_id: r.after >= 2 for r in got.collect()} == presence_loop(data, 100, 250, 2)


def test_a_restart_goes_on_from_the_checkpoint_and_late_rows_are_dropped(spark, tmp_path):
    """Half of the files, a stop, the rest: as if in one go. What comes behind the watermark is left out and counted."""
    data = events(seed=5)
    rows = spark.createDataFrame(data, SCHEMA)
    session, path = stateful.stateful_session(spark), str(tmp_path)

    def go():
        live = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = stateful.scanned(live, scan.protocol(decode.SEVEN, 6), first_end(), NEAR)
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    early = rows.where("first_s < 2000")
    early.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{path}/in")
    early.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{path}/in")
    go()
    answered = spark.read.parquet(f"{path}/out").count()
    assert 0 < answered < early.count()  # the last rows wait for the watermark
    late = spark.createDataFrame([(9001, 0, "wiring", 3, 9, 1), (9002, 1, "cleanup", 5, 9, 1)], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(f"{path}/in")
    go()
    rest = rows.where("first_s >= 2000")
    stateful.arrivals(rest, F.col("first_s"), f"{path}/in", 2, 10**6)
    go()
    got = staged(spark.read.parquet(f"{path}/out"))
    assert got == machine_loop(data) and 9001 not in got


def test_two_means_by_aggregates_is_that_of_sorted_rows(spark):
    rng = random.Random(6)
    data = [(k, rng.gauss(100 * (rng.random() < 0.4), 20 + k)) for k in range(5) for _ in range(200)] + [(9, 5.0)] * 4 + [(10, None), (11, float("nan")), (11, 3.0), (None, 1.0), (None, 9.0)]
    df = spark.createDataFrame(data, "entity long, v double")
    got = {r.entity: (r.low, r.high, r["size"]) for r in clusters.two_means(df, "v", ["entity"]).collect()}
    import math

    import numpy as np

    want = {}
    for k in {d[0] for d in data}:
        x = np.array([v for e, v in data if e == k and v is not None and not math.isnan(v)])
        if len(x):
            want[k] = (*decode.two_means(x), len(x))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_shared_threshold(spark):
    def one(values, **how):
        r = clusters.shared_threshold(spark.createDataFrame([(v,) for v in values], "v double"), "v", [], fallback=0.8, apart=0.18, least_high=0.7, **how).collect()
        return [(r[0].threshold, r[0].low, r[0].high)] if r else []

    assert one([]) == []
    assert one([0.1, 0.9, 0.95]) == [(0.8, None, None)]
    assert one([0.1, 0.2, 0.9, 1.0]) == [(pytest.approx(0.55), pytest.approx(0.15), pytest.approx(0.95))]
    assert one([0.1, 0.12, 0.2, 0.25])[0][0] == 0.8  # too low
    assert one([0.8, 0.85, 0.9, 0.9])[0][0] == 0.8  # too close
