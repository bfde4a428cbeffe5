"""Distinct values are counted by the cells themselves, and only of columns that can matter."""

from sextant.operators import frequencies, roles


def test_zeros_and_missing_numbers(spark):
    rows = [(0.0, 1, "a"), (-0.0, 1, "a"), (float("nan"), 2, None), (None, None, "b"), (2.5, -1, "")]
    df = spark.createDataFrame(rows, "x double, n bigint, t string")
    assert frequencies.cardinalities(df, ["x", "n", "t"]) == {"x": 2, "n": 3, "t": 3}
    assert {r["column"]: r["n_distinct"] for r in frequencies.cardinality(df).collect()} == {"x": 2, "n": 3, "t": 3}


def test_groupings_count_only_metrics_that_can_be_among_the_first(spark, monkeypatch):
    asked, count = [], roles.cardinalities
    monkeypatch.setattr(roles, "cardinalities", lambda df, columns: asked.append(list(columns)) or count(df, columns))
    rows = [("a" if k % 2 else "b", float(k), k % 5 * 1.0, k % 7 * 1.0, k % 3 * 1.0) for k in range(20)]
    df = spark.createDataFrame(rows, "kind string, other double, price double, net_amount double, amount double")
    found = [(r["group_col"], r["metric_col"], r["n_levels"]) for r in roles.suggested_groupings(df).orderBy("position").collect()]
    assert found == [("kind", "net_amount", 2), ("kind", "price", 2), ("kind", "amount", 2)]
    assert asked == [["price", "net_amount", "amount", "kind"]]
    fewer = [(r["metric_col"]) for r in roles.suggested_groupings(df.drop("amount")).orderBy("position").collect()]
    assert fewer == ["net_amount", "price", "other"]
