"""Registered queries against their check SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Covered by unit tests on smaller data; they train models.
SLOW = {"clf_leaderboard", "reg_leaderboard", "feature_importance", "automl_facts"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def test_every_check_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(tuple(cell(row[p]) for p in places) for row in result.fetchall())
