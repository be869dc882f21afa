"""A replay loses no row, however many tasks hold the table and whichever of their files is the newest."""

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import scan
from chronoweave.streaming import stateful


@pytest.mark.parametrize("start", [0, -5000, 10**6])
def test_replay_of_many_partitions(spark, start):
    data = [(i % 5, i, start + i * 100, i % 2 * 7) for i in range(2000)]
    rows = spark.createDataFrame(data, "entity long, event_id long, first_s long, conf long")
    # the tasks' files of a stretch are far apart in time, the latest rows first
    spread = rows.repartitionByRange(8, F.desc("first_s"))
    symbol = scan.persistence_symbol(F.col("conf"), F.lit(2), F.lit(5))
    got = stateful.replayed(spark, spread, scan.persistence(2), symbol, arrival=F.col("first_s") + F.col("event_id") * 37 % 500, late_s=600, files=2)
    assert sorted(r.event_id for r in got.collect()) == list(range(2000))
