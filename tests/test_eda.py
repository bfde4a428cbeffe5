"""The long exploratory table: text dates, odd numbers, empty tables, and how often the data is scanned."""

import pytest

from sextant.operators import eda


def rows_of(df):
    return {(r["section"], r["column"], r["key"]): (r["n"], r["value"]) for r in eda.eda_sections(df).collect()}


def test_sections(spark):
    inf, nan = float("inf"), float("nan")
    data = [(f"{d:02d}/01/2024", "a" if d % 2 else "b", float(d), d % 3 == 0) for d in range(1, 11)]
    data += [("13/01/2024", None, inf, None), ("2024-01-14 00:00:00", "a", nan, True), (None, "a", 5.0, None)]
    df = spark.createDataFrame(data, "day string, kind string, price double, flag boolean")
    found = rows_of(df)
    assert found["missing", "day", None] == (1, pytest.approx(100 / 13))
    assert found["missing", "price", None][0] == 1
    assert ("value_counts", "day", "13/01/2024") not in found
    assert found["value_counts", "kind", "a"] == (7, None) and found["value_counts", "flag", "true"] == (4, None)
    assert found["daily_mean", "price by day", "2024-01-03"] == (1, 3.0)
    assert found["daily_mean", "price by day", "2024-01-13"] == (1, inf)
    assert ("daily_mean", "price by day", "2024-01-14") not in found
    assert found["group_mean", "price by kind", "b"] == (5, 6.0)
    assert found["group_mean", "price by flag", "false"] == (7, pytest.approx((55 - 18) / 7))
    assert found["histogram", "price", "29"] == (1, None) and sum(n for (s, *_), (n, _) in found.items() if s == "histogram") == 11


def test_odd_tables(spark):
    assert eda.eda_sections(spark.createDataFrame([], "a int, b string")).where("n > 0").collect() == []
    found = rows_of(spark.createDataFrame([(7,), (7,)], "a int"))
    assert found["histogram", "a", "0"] == (2, None) and found["describe", "a", "std"] == (2, 0.0)
    assert rows_of(spark.createDataFrame([("x",), (None,)], "b string"))["value_counts", "b", "x"] == (1, None)


def test_three_scans(spark, sf, monkeypatch):
    read = []
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    for name in ("agg", "select"):
        original = getattr(type(orders), name)
        monkeypatch.setattr(type(orders), name, lambda self, *a, f=original, n=name: read.append(n) or f(self, *a) if self is orders else f(self, *a))
    eda.eda_sections(orders).collect()
    assert len(read) == 3
