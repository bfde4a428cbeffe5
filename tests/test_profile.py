"""Profiles, quantiles and cleaning on small tables with known answers."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.operators import clean as C
from sextant.operators import frequencies as Q
from sextant.operators import labels as L
from sextant.operators import profile as P
from sextant.operators.quantiles import column_quantiles, grouped_medians

MESSY = [
    ("USA", 10.0, "1", "a"),
    ("US", 12.0, "2", None),
    ("United States", 11.0, "3", "c"),
    ("USA", 10.0, "1", "a"),
    ("Canada", 9.0, "4", "e"),
    ("Canada", 500.0, "5", "f"),
    ("USA", 10.0, "1", "a"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, "region string, amount double, qty_text string, note string").cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_duplicates(messy):
    assert P.duplicate_count(messy).first().asDict() == {"n_rows": 7, "n_duplicates": 2}
    assert [r["copies"] for r in P.duplicate_groups(messy).collect()] == [3]


def test_missing(messy):
    assert [tuple(r) for r in P.missing_profile(messy).collect()] == [("note", 1, 14.29)]
    assert P.missing_heaviest(messy).first()["column"] == "note"
    assert P.missing_heaviest(messy, above_pct=20).count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert P.missing_profile(df).first()["n_missing"] == 2
    assert P.describe(df).first()["count"] == 1


def test_numbers_as_text(messy):
    assert [r["column"] for r in P.numbers_as_text(messy).collect()] == ["qty_text"]


def test_outliers_are_flagged_and_kept(messy):
    found = P.iqr_outliers(messy).first()
    assert (found["column"], found["n_outliers"], found["pct"]) == ("amount", 1, 14.29)
    assert P.outlier_examples(messy).first()["example"] == 500.0
    assert C.auto_clean(messy).data.agg(F.max("amount")).first()[0] == 500.0


def test_auto_clean(messy):
    result = C.auto_clean(messy)
    data = result.data.collect()
    assert len(data) == 5
    assert dict(result.data.dtypes)["qty_text"] == "double"
    assert all(r["note"] is not None for r in data)
    log = [(r["action"], r["column"]) for r in result.log.orderBy("step").collect()]
    assert log == [("drop_duplicates", None), ("cast_to_number", "qty_text"), ("impute_mode", "note")]


def test_auto_clean_of_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "id int, note string")
    data = C.auto_clean(df).data.collect()
    assert {r["note"] for r in data} == {"Unknown"}


def test_suggestions(messy):
    found = {(r["action"], r["column"]): r["auto"] for r in C.quality_suggestions(messy).collect()}
    assert found == {
        ("drop_duplicates", None): True,
        ("impute_mode", "note"): True,
        ("fix_dtype", "qty_text"): True,
        ("review_outliers", "amount"): False,
        ("review_categories", "region"): False,
    }


def test_label_groups(messy):
    groups = [(r["group_no"], r["label"]) for r in L.similar_label_groups(messy, ["region"]).collect()]
    assert sorted(groups) == [(1, "US"), (1, "USA")]
    pairs = L.similar_label_pairs(messy, ["region"]).collect()
    assert [(r["label_a"], r["label_b"]) for r in pairs] == [("US", "USA")]


def test_label_gate(spark):
    wide = spark.range(81).selectExpr("concat('label', id) as x")
    narrow = spark.range(80).selectExpr("concat('label', id) as x")
    assert L.label_table(wide).count() == 0
    assert L.label_table(narrow).count() == 80


def test_decisions_and_merge(spark):
    df = spark.createDataFrame(
        [("USA", 10, 1), ("US", 12, 2), ("United States", 11, 3), ("USA", 10, 4), ("US", 9, 5), ("USA", 8, 6), (None, 1, 7)],
        "region string, amount int, customer_id int",
    )
    decisions = C.quality_decisions(df)
    found = rows(decisions, "type", "column")
    assert found[("category_merge", "region")]["primary"] == "USA"
    assert ("id_or_feature", "customer_id") in found
    merged = C.apply_label_map(df, C.decisions_to_label_map(decisions), ["region"])
    assert {r["region"] for r in merged.collect()} == {"USA", "United States", None}
    assert C.merge_labels(df, "region", ["US"], "USA").where("region is null").count() == 1


def test_id_like(spark):
    df = spark.range(100).selectExpr("id as row_id", "id % 3 as grp", "id as serial")
    assert {r["column"] for r in C.id_like_columns(df).collect()} == {"row_id", "serial"}


def test_score_caps(spark):
    df = spark.createDataFrame([("1", "2", "3", None)] * 10, "a string, b string, c string, d string")
    scored = P.quality_score(df).first()
    assert scored["type_penalty"] == 15.0
    assert scored["duplicate_penalty"] == 20.0
    assert scored["missing_penalty"] == 25.0
    assert scored["score"] == 40.0


def test_describe_one_value_and_empty(spark):
    one = spark.createDataFrame([(3,)], "a int")
    assert P.describe(one).first()["std"] == 0.0
    assert P.describe(one.where("a > 5")).count() == 0
    assert P.histogram(one, "a").agg(F.sum("n")).first()[0] == 1


def test_spike_needs_few_values(spark):
    few = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(1000.0,)], "x double")
    many = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(1000.0,)] * 12, "x double")
    assert [(r["kind"], r["n_flagged"]) for r in P.spike_dip(few).collect()] == [("spike", 1)]
    assert P.spike_dip(many).count() == 0


def test_imbalance_counts_null(spark):
    df = spark.createDataFrame([(None,)] * 9 + [("x",)], "c string")
    assert P.imbalance(df).first()["top_value"] == "__null__"


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 3.0), (4.0, 8.0, 5.0, 2.0)],
        "a double, b double, flat double, gaps double",
    )
    r = {(x["col_a"], x["col_b"]): x["r"] for x in P.corr_matrix(df).collect()}
    assert r[("a", "b")] == 1.0 and r[("b", "a")] == 1.0
    assert r[("a", "flat")] is None
    assert r[("a", "gaps")] == 0.5
    assert P.corr_pairs(df, ["a", "b"]).count() == 1


def test_low_variance(spark):
    df = spark.range(100).selectExpr(
        "7.0D as flat", "1000.0D + id % 2 as near", "cast(id as double) as fine", "if(id = 3, 1.0D, null) as lone"
    )
    reason = {r["column"]: r["reason"] for r in P.low_variance(df).collect()}
    assert reason == {"flat": "constant", "near": "nearly_constant", "fine": None, "lone": "too_few"}


@pytest.mark.parametrize("limit", [10, 300, 10_000_000])
def test_quantiles_match_numpy_on_skewed_values(spark, limit):
    """A third of the rows share one value; limits force the narrowing path, its slices, or neither."""
    rng = random.Random(5)
    values = [7.25] * 2000 + [rng.lognormvariate(0, 4) for _ in range(3000)] + [-rng.random() * 1e6 for _ in range(1000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v, None) for v in values], "x double, hollow double").repartition(8)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    found = column_quantiles(df, ["x", "hollow"], probs, one_task_rows=limit, buffer_rows=limit)
    assert found["x"].n == len(values)
    assert found["x"].values == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert found["hollow"].values == [None] * len(probs)


def test_quantiles_with_infinite_and_tiny_values(spark):
    tiny = 5e-324
    values = [float("-inf")] * 20 + [float("inf")] * 20 + [0.0] * 15 + [tiny] * 15 + [float(i) for i in range(1, 30)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    ordered = sorted(values)
    for k in (0, 19, 25, 40, 45, 60, len(values) - 1):
        p = k / (len(values) - 1)
        assert column_quantiles(df, ["x"], (p,), 4, 3)["x"].values[0] == pytest.approx(ordered[k], abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_quantiles_match_numpy_on_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = column_quantiles(df, ["x"], (0.25, 0.5), one_task_rows=5, buffer_rows=3)["x"].values
    assert found == pytest.approx(list(np.quantile(values, (0.25, 0.5))), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("limit", [5, 100_000])
def test_grouped_medians_of_a_hot_group(spark, limit):
    rng = random.Random(2)
    data = [("hot", rng.random()) for _ in range(400)] + [(f"g{i % 7}", float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    found = {r["g"]: r["m"] for r in grouped_medians(df, ["g"], "v", "m", limit).collect()}
    for g in {g for g, _ in data}:
        assert found[g] == pytest.approx(statistics.median(v for k, v in data if k == g))


def test_value_counts_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [(r["value"], r["rank"]) for r in Q.value_counts_topk(df, ["x"], 2).orderBy("rank").collect()] == [
        ("c", 1),
        ("a", 2),
    ]
    assert P.median_mode(spark.createDataFrame([("b",), ("a",)], "x string")).first()["mode"] == "a"
