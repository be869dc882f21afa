"""Runs and what is built of them sort an entity's rows once and stay spread over all tasks."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import intervals

SCHEMA = "entity long, action string, first_s long, last_s long, event_id long"


def rows(n=400):
    rng = random.Random(7)
    return [(rng.randrange(5), rng.choice(["a", "b", None]), t := rng.randrange(-5000, 90000), t + rng.randrange(0, 9000), i) for i in range(n)]


def plain_runs(rows, gap):
    out, now = [], {}
    for e, a, f, l, _ in sorted(rows, key=lambda r: (r[0], *r[2:])):
        run = now.get(e)
        if run and a is not None and run[1] == a and f <= run[3] + gap:
            run[3], run[4] = max(run[3], l), run[4] + 1
        else:
            now[e] = [e, a, f, l, 1, (run[5] if run else 0) + 1]
            out.append(now[e])
    return out


def test_runs_and_filled_gaps_against_loops(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = intervals.stage_runs(df, gap=600)
    want = plain_runs(rows(), 600)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)) for r in want)
    low, high, filled = 1000, 80000, []
    for e in range(5):
        at = low
        for _, a, f, l, _, _ in sorted((r for r in want if r[0] == e), key=lambda r: (r[2], r[3], r[5])):
            if l > low and f < high:
                filled += [(e, "unclassified", at, f)] * (f > at) + [(e, a, max(f, at), min(l, high))] * (min(l, high) > max(f, at))
                at = max(at, min(l, high))
        filled += [(e, "unclassified", at, high)] * (at < high)
    got = intervals.gap_fill(got, F.lit(low).cast("long"), F.lit(high).cast("long"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, filled))


def test_rows_are_sorted_once_for_runs_and_once_for_gaps(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    runs = intervals.stage_runs(df)
    plan = lambda x: x._jdf.queryExecution().sparkPlan().toString() + x._jdf.queryExecution().executedPlan().toString()
    assert plan(runs).count("Sort [") == 1
    assert plan(intervals.gap_fill(runs, F.lit(0), F.lit(90000))).count("Sort [") == 2


def test_small_runs_stay_in_all_tasks(spark):
    """Rows of a few bytes would be joined to one task."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert intervals.stage_runs(spark.createDataFrame(rows(), SCHEMA)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
