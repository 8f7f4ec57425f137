"""Every query with an oracle agrees with DuckDB on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from tracewright.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{SF}/events.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == names
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types, strict=True)}
    place = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[k]) for k in place) for r in relation.fetchall()), key=str)
    assert mine and mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
