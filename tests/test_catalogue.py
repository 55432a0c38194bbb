"""Every catalogued query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quarryline import catalogue, catalogue_code, oracles, oracles_code

QUERIES = catalogue.QUERIES | catalogue_code.QUERIES
ORACLES = oracles.ORACLES | oracles_code.ORACLES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def plain(value):
    return None if value is None else f"{value:.5f}" if isinstance(value, float) and math.isfinite(value) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == 70


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    relation = sql.execute(ORACLES[name])
    columns = [d[0] for d in relation.description]
    want = [tuple(map(plain, r)) for r in relation.fetchall()]
    assert sorted(got.columns) == sorted(columns) and want
    key = lambda r: tuple(x or "" for x in r)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)
