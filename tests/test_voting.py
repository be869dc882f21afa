"""Percentiles between two values as DuckDB rounds them."""

import random

import duckdb

from chronoweave.operators import voting


def test_percentiles_round_as_the_sql(spark):
    dice = random.Random(5)
    rows = [(n, dice.randint(0, 1000)) for n in range(1, 80) for _ in range(n)] + [(None, 3), (None, 8), (99, None)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (entity BIGINT, v BIGINT)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = duck.execute("SELECT entity, quantile_cont(CAST(v AS DOUBLE), 0.2), quantile_cont(CAST(v AS DOUBLE), 0.9) FROM t GROUP BY entity").fetchall()
    got = voting.percentiles(spark.createDataFrame(rows, "entity long, v long"), "v", {"l": 0.2, "h": 0.9}).collect()
    assert {tuple(r) for r in got} == set(want)


def test_normalized_keeps_all_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 7), (1, 3, None), (1, 4, 4), (1, 5, 9)], "entity long, event_id long, v long")
    got = {r.event_id: r.normalized for r in voting.percentile_normalized(rows, "v").collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[1] == 0 and got[5] == 1
