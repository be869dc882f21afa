"""Every query with SQL gives DuckDB's rows; the others are held against a plain version."""

import math

import duckdb
import pytest

import chronoweave.plans.evidence_queries  # noqa: F401
import chronoweave.plans.source_queries  # noqa: F401
import chronoweave.plans.structure_queries  # noqa: F401
import chronoweave.plans.window_queries  # noqa: F401
from chronoweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    data = want.fetchall()
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, data)
    assert data or name in ("exact_duplicates",)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
