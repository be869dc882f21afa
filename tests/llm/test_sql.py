"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from chronoweave.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(registry.ORACLES[name])
    names = sorted(x[0] for x in want.description)
    place = [[x[0] for x in want.description].index(n) for n in names]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
