"""Cases of wide tables, null keys, unreadable dates, padded labels and infinite values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import tails
from sextant.operators import audit, clean, ml, profile, relational, trend
from sextant.operators.joins import small_side
from sextant.operators.quantiles import column_quantiles, grouped_medians
from sextant.sources.csv import read_csv


def test_events_without_a_key_are_numbered(spark):
    df = spark.createDataFrame(
        [(None, "2024-01-01", 1), (None, "2024-01-03", 2), ("a", "2024-01-02", 3)], "k string, t string, i int"
    ).withColumn("t", F.to_timestamp("t"))
    for limit in (100, 1):
        found = relational.event_index(df, "t", ["i"], ["k"], limit)
        rows = sorted((r["i"], r["event_no"], r["elapsed_days"]) for r in found.collect())
        assert rows == [(1, 1, 0.0), (2, 2, 2.0), (3, 1, 0.0)]


def test_quantiles_are_equal_on_both_paths(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.lognormvariate(0, 3),) for _ in range(4001)], "v double")
    probs = [0.1, 0.25, 0.333, 0.5, 0.75, 0.9]
    small = column_quantiles(df, ["v"], probs)["v"]
    assert column_quantiles(df, ["v"], probs, one_task_rows=50, buffer_rows=0)["v"] == small


def test_medians_of_a_null_group_on_both_paths(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([None, "a"]), rng.random()) for _ in range(500)], "k string, v double")
    expected = {r["k"]: r["m"] for r in grouped_medians(df, ["k"], "v", "m").collect()}
    assert {r["k"]: r["m"] for r in grouped_medians(df, ["k"], "v", "m", 10).collect()} == expected and None in expected


def test_a_spike_in_the_13th_column_is_found(spark):
    columns = [f"if(id = 7, 1e6, id % 10) as c{i}" if i == 12 else f"double(id % 10) as c{i}" for i in range(14)]
    found = profile.spike_dip(spark.range(100).selectExpr(*columns)).collect()
    assert [(r["column"], r["kind"]) for r in found] == [("c12", "spike")]


def test_a_long_horizon_is_honoured(spark):
    df = spark.range(20).selectExpr("timestamp_seconds(id * 86400) as t", "double(id) as y")
    assert trend.forecast_by_time(df, "t", "y", horizon=90).count() == 90


def test_unreadable_dates_need_an_order(spark):
    df = spark.range(10).selectExpr("concat('x', id) as t", "id", "double(id) as y")
    with pytest.raises(ValueError):
        trend.forecast_by_time(df, "t", "y")
    found = trend.forecast_by_time(df, "t", "y", horizon=2, order_by=["id"]).collect()
    assert [r["period"] for r in sorted(found, key=lambda r: r["h"])] == ["Event +1", "Event +2"]


def test_every_series_has_a_status(spark):
    df = spark.createDataFrame(
        [("empty", "2024-01-01", None), ("undated", None, 1.0), (None, "2024-01-01", 1.0)]
        + [("ok", f"2024-01-{d:02d}", float(d * d)) for d in range(1, 9)],
        "k string, t string, y double",
    ).withColumn("t", F.to_timestamp("t"))
    fit = trend.trend_fit(trend.Series.by_time(df, "t", "y", ["k"]))
    assert {r["k"]: (r["n"], r["status"]) for r in fit.collect()} == {
        "empty": (0, "too_few"), "undated": (0, "too_few"), None: (1, "too_few"), "ok": (8, "ok"),
    }


def test_padded_labels_are_merged(spark):
    df = spark.createDataFrame([(" usa ",), ("usa",), ("USA",), (None,)], "c string")
    to = spark.createDataFrame([("c", "usa", "USA")], "column string, label string, primary string")
    assert [r["c"] for r in clean.apply_label_map(df, to, ["c"]).orderBy(F.asc_nulls_last("c")).collect()] == ["USA"] * 3 + [None]


def test_both_gates_agree(spark):
    parts = ["SELECT 1", ";", "\t", "\n", " ", "--x", "/* y */", "DROP", "\u00a0", "with a", "\x1f"]
    rng = random.Random(1)
    texts = ["SELECT 1;\t", "", " ; "] + ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(400)]
    found = audit.audit_sql(spark.createDataFrame([(t,) for t in texts], "s string"), "s").collect()
    for r in found:
        assert (r["ok"], r["reason"] if not r["ok"] else "") == audit.is_read_only(r["s"]), repr(r["s"])


def test_duplicates_of_nan_and_null_count(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 3.0)], "a int, v double")
    assert profile.quality_score(df).first()["duplicate_penalty"] > 0


def test_histogram_leaves_infinite_values_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),)], "v double")
    rows = profile.histogram(df, "v", 3).collect()
    assert sum(r["n"] for r in rows) == 10 and max(r["upper"] for r in rows) == 9.0


def test_outlier_rows(spark):
    df = spark.range(30).selectExpr("id", "if(id = 4, 900, id % 5) as v")
    assert [(r["id"], r["outlier_columns"]) for r in profile.outlier_rows(df, ["v"]).collect()] == [(4, ["v"])]


def test_split_without_a_label_is_exact(spark):
    split = ml.stratified_split(spark.range(1003), None, ["id"])
    assert split.where("split = 'test'").count() == 201


def test_an_event_word_counts_events(spark):
    row = spark.range(1).select(
        trend.horizon_steps("season", F.lit(7.0), F.lit(False)).alias("season"),
        trend.horizon_steps("year", F.lit(7.0), F.lit(False)).alias("year"),
        trend.horizon_steps("match", F.lit(1.0), F.lit(False)).alias("match"),
    ).first()
    assert (row["season"], row["year"], row["match"]) == (10, 52, 5)


def test_tails_have_one_formula_at_every_size():
    for dof in (1e7 - 1, 1e7 + 1, 1e9, 1e12, 1e15):
        for t in (0.5, 1.96, 6.0):
            limit = math.erfc(t / math.sqrt(2))
            assert abs(tails.t_two_sided(t, dof) / limit - 1) < 500 / dof + 1e-12
    assert abs(tails.f_upper(9.0, 2.0, 4.0) - 0.033057851239669) < 1e-12  # (1 + f d1 / d2) ** -2


def test_bands_of_any_width(spark):
    rows = [(i, float(v)) for i, v in enumerate([-3, 0, 6.999, 7, 100, 2.9e9, 3e9, 5e12])] + [(99, None)]
    cells = [("wide", 0.0, 3e9), ("narrow", 0.0, 7.0), ("none", 5.0, 5.0), ("open", None, 4.0), ("below", -1e13, 0.0), ("tiny", 6.99, 7.0)]
    df = spark.createDataFrame(rows, "id int, v double")
    bands = spark.createDataFrame(cells, "band string, low double, high double")
    found = relational.band_join(df, bands, "v", "low", "high", 1.0)
    expected = {(i, b) for i, v in rows for b, lo, hi in cells if None not in (v, lo) and lo <= v < hi}
    assert sorted((r["id"], r["band"]) for r in found.collect()) == sorted(expected)
    assert relational.band_join(df, bands.limit(0), "v", "low", "high", 1.0).count() == 0


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"line one\nline two"\n2,"say ""hi"""\n3,plain\n')
    rows = [(r["id"], r["note"]) for r in read_csv(spark, str(path)).orderBy("id").collect()]
    assert rows == [(1, "line one\nline two"), (2, 'say "hi"'), (3, "plain")]


def test_a_wide_side_is_not_broadcast(spark):
    narrow = spark.range(10).selectExpr("id", "cast(null as string) as s", "array(id) as a", "cast('x' as binary) as b")
    wide = spark.range(40).selectExpr("id", "repeat('x', 1000000) as s")
    plans = [small_side(side)._jdf.queryExecution().logical().toString() for side in (narrow, wide)]
    assert ["ResolvedHint" in p or "UnresolvedHint" in p for p in plans] == [True, False]


def test_duplicates_by_fingerprint_are_exact(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, None, None), (None, None, None), (None, None, None), (2, "b", "c")]
    df = spark.createDataFrame(rows, "a int, b string, a_b string")
    assert tuple(profile.duplicate_count(df).first()) == (7, 3)
    found = sorted((r["a"] or 0, r["copies"]) for r in profile.duplicate_groups(df).collect())
    assert found == [(0, 3), (1, 2)]
    assert tuple(profile.duplicate_count(df.limit(0)).first()) == (0, 0)


def test_a_flat_metric_is_changed(spark):
    df = spark.range(20).selectExpr("timestamp_seconds(id * 86400) as t", "2026 as season_no", "double(id * id) as sales")
    assert trend.settled_metric(df, "season_no", ["t"]) == "sales"
    assert trend.settled_metric(df, "sales", ["t"]) == "sales"
    assert trend.settled_metric(df.drop("sales"), "season_no", ["t"]) == "season_no"
