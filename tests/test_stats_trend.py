"""Tests, trends and dates against hand-computed or brute-force values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import tails
from sextant.functions.dates import parse_mixed_date
from sextant.operators import stats as S
from sextant.operators import trend as T


def test_tail_tables():
    """Published critical values."""
    for t, dof, p in ((12.7062, 1, 0.05), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (1.9840, 100, 0.05), (1.959964, 1e9, 0.05)):
        assert tails.t_two_sided(t, dof) == pytest.approx(p, rel=2e-4)
    for f, d1, d2, p in ((4.1028, 2, 10, 0.05), (2.8661, 4, 20, 0.05), (161.4476, 1, 1, 0.05), (2.9957, 2, 1e9, 0.05)):
        assert tails.f_upper(f, d1, d2) == pytest.approx(p, rel=2e-4)
    assert tails.t_two_sided(0.0, 5) == 1.0


def integrated_t_tail(t, dof):
    """Two-sided tail by the trapezoid rule, with the unit interval mapped onto the half line."""
    u = np.linspace(0, 1, 400_001)[:-1]
    x = abs(t) + u / (1 - u)
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    y = scale * (1 + x * x / dof) ** (-(dof + 1) / 2) / (1 - u) ** 2
    return 2 * float(np.sum((y[1:] + y[:-1]) / 2) * (u[1] - u[0]))


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("lone", 1.0), (None, 3.0)], "g string, x double")
    row = S.welch_t(df, "g", "x").first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert row["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert row["dof"] == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4))
    assert row["p_value"] == pytest.approx(integrated_t_tail(row["t"], row["dof"]), rel=1e-6)
    assert row["small_sample"] and not row["significant"]
    assert [r["test"] for r in S.compare_groups(df, "g", "x").collect()] == ["welch_t"]


def test_zero_variance_is_undefined(spark):
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    row = S.welch_t(flat, "g", "x").first()
    assert row["t"] is None and row["p_value"] is None and row["significant"] is None
    three = flat.unionByName(spark.createDataFrame([("c", 3.0), ("c", 3.0)], "g string, x double"))
    row = S.anova_f(three, "g", "x").first()
    assert row["f"] is None and row["significant"] is None


def test_anova(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    row = S.anova_f(df, "g", "x").first()
    assert row["f"] == pytest.approx(9.3, abs=0.05)
    assert row["p_value"] == pytest.approx(0.0024, abs=2e-4) and row["significant"]


def test_corr_ranking(spark):
    df = spark.range(40).selectExpr(
        "cast(id as double) as x", "cast(id * id as double) as square", "1.0D as flat", "if(id < 20, 'no', 'yes') as churn"
    )
    ranked = S.corr_ranking(df).collect()
    assert [r["column"] for r in ranked] == ["x", "square"]
    assert ranked[0]["strength"] == "strong" and ranked[0]["direction"] == "positive" and ranked[0]["p_value"] < 1e-6
    with pytest.raises(ValueError, match="no variance"):
        S.corr_ranking(df, "flat")


DATES = {
    "13/03/2024": "2024-03-13 00:00:00",
    "03/25/2024": "2024-03-25 00:00:00",
    "05/06/2024": "2024-06-05 00:00:00",
    "13.03.24": "2024-03-13 00:00:00",
    "2024-07-03 00:00:00": "2024-07-03 00:00:00",
    "2024-3-5T10:11:12": "2024-03-05 10:11:12",
    "13/03/2024 18:45": "2024-03-13 18:45:00",
    "5 Mar 2024": "2024-03-05 00:00:00",
    "March 5, 2024": "2024-03-05 00:00:00",
    "2024/3/5": "2024-03-05 00:00:00",
    "13-3-2024": "2024-03-13 00:00:00",
    "13/13/2024": None,
    "2024-02-31": None,
    "nan": None,
    " ": None,
    "order 12": None,
}


def test_mixed_dates(spark):
    df = spark.createDataFrame([(x,) for x in DATES], "x string")
    shown = df.select("x", F.date_format(parse_mixed_date(F.col("x")), "yyyy-MM-dd HH:mm:ss").alias("p"))
    assert {r["x"]: r["p"] for r in shown.collect()} == DATES
    meta = T.date_parse_quality(df, ["x"]).first()
    assert (meta["n_total"], meta["n_non_null"], meta["n_parsed"], meta["n_failed"]) == (16, 14, 11, 3)
    assert meta["parse_ok"] and meta["warning"]


def series(spark, days, values, keys=None):
    start = dt.datetime(2024, 1, 1)
    data = [(k, start + dt.timedelta(days=d), float(v)) for k, d, v in zip(keys or ["s"] * len(days), days, values)]
    return spark.createDataFrame(data, "k string, ts timestamp, y double")


def brute_forecast(t, y, gap, horizon):
    slope, intercept = np.polyfit(t, y, 1)
    s = np.std(y - intercept - slope * np.array(t), ddof=2)
    rows = []
    for h in range(1, horizon + 1):
        p = intercept + slope * (t[-1] + gap * h)
        half = 1.96 * s * (1 + 0.1 * h)
        rows.append((p, p - half, p + half))
    return rows


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_forecast_of_many_series(spark, limit):
    """The small limit sends every series down the sliced path."""
    days = list(range(0, 120, 10))
    y = [50 + 3 * i + (-1) ** i * 4 for i in range(12)]
    df = series(spark, days * 2, y + [-v for v in y], ["up"] * 12 + ["down"] * 12)
    fitted = T.Series.by_time(df, "ts", "y", ["k"], limit)
    rows = T.trend_forecast(T.trend_fit(fitted), ["k"], 4).collect()
    for k, sign in (("up", 1), ("down", -1)):
        found = sorted((r["h"], r["forecast"], r["lower_95"], r["upper_95"]) for r in rows if r["k"] == k)
        expected = brute_forecast(days, [sign * v for v in y], 10, 4)
        for row, wanted in zip(found, expected):
            assert row[1:] == pytest.approx(wanted)
    assert {r["period"] for r in rows if r["h"] == 1} == {"2024-04-30"}


def test_counts_are_clipped_at_zero(spark):
    rows = T.forecast_by_time(series(spark, range(0, 42, 7), [5, 4, 3, 2, 1, 0]), "ts", "y", horizon=6).collect()
    assert min(r["lower_95"] for r in rows) == 0.0 and min(r["forecast"] for r in rows) == 0.0


def test_irregular_series_get_event_labels(spark):
    rows = T.forecast_by_time(series(spark, [0, 1, 2, 30, 31, 90], range(6)), "ts", "y", horizon=2).collect()
    assert [r["period"] for r in sorted(rows, key=lambda r: r["h"])] == ["Event +1", "Event +2"]


def test_event_order_without_dates(spark):
    df = spark.createDataFrame([(i, float(10 + 2 * i)) for i in range(6)], "i int, sales double")
    first = T.forecast_by_order(df, ["i"], "sales", horizon=3).orderBy("h").first()
    assert first["forecast"] == pytest.approx(22.0) and first["period"] == "Event +1"


def test_status(spark):
    df = series(
        spark,
        [0, 0, 1, 1] + [0, 1, 2, 3] + [0, 1, 2, 3] + [0, 1, 2, 3],
        [1, 2, 3, 4] + [5, 5, 5, 5] + [1000, 1001, 1000, 1001] + [1, 2, 4, 3],
        ["two_dates"] * 4 + ["flat"] * 4 + ["near"] * 4 + ["fine"] * 4,
    )
    fit = T.trend_fit(T.Series.by_time(df, "ts", "y", ["k"]))
    assert {r["k"]: r["status"] for r in fit.collect()} == {
        "two_dates": "too_few", "flat": "constant", "near": "nearly_constant", "fine": "ok",
    }
    assert {r["k"] for r in T.trend_forecast(fit, ["k"], 2).collect()} == {"fine"}


def test_text_dates_and_duplicate_dates_are_averaged(spark):
    df = spark.createDataFrame(
        [("13/03/2024", 1.0), ("2024-03-13", 3.0), ("2024-03-14", 4.0), ("2024-03-15", 5.0), ("soon", 9.0)], "d string, y double"
    )
    fit = T.trend_fit(T.Series.by_time(df, "d", "y")).first()
    assert fit["n"] == 3 and fit["status"] == "ok" and fit["slope"] == pytest.approx(1.5)


@pytest.mark.parametrize(
    "period,gap,irregular,steps",
    [("year", 7.0, False, 52), ("month", 7.0, False, 4), ("week", 30.0, False, 1), ("day", 1.0, False, 7), ("", 1.0, False, 3),
     ("season", 1.0, True, 10), ("quarter", 1.0, True, 6), ("", 1.0, True, 5)],
)
def test_horizon(spark, period, gap, irregular, steps):
    row = spark.range(1).select(T.horizon_steps(period, F.lit(gap), F.lit(irregular)).alias("n")).first()
    assert row["n"] == steps


def test_each_series_has_its_own_clock(spark):
    rows = [("a", f"2024-01-{d:02d}", d, float(d)) for d in range(1, 9)]
    rows += [("b", "some day", d, 2.0 * d) for d in range(1, 9)]
    rows += [("c", "2024-01-01" if d < 3 else "later", d, 5.0 - d) for d in range(1, 9)]
    rows += [(None, None, d, float(d)) for d in range(1, 5)]
    df = spark.createDataFrame(rows, "k string, when string, no int, y double")
    found = {}
    for r in T.forecast_by_time(df, "when", "y", ["k"], horizon=2, order_by=["no"]).collect():
        found.setdefault(r["k"], []).append((r["h"], r["period"], round(r["forecast"], 6)))
    assert {k: sorted(v) for k, v in found.items()} == {
        "a": [(1, "2024-01-09", 9.0), (2, "2024-01-10", 10.0)],
        "b": [(1, "Event +1", 18.0), (2, "Event +2", 20.0)],
        "c": [(1, "Event +1", -4.0), (2, "Event +2", -5.0)],
        None: [(1, "Event +1", 5.0), (2, "Event +2", 6.0)],
    }
    by_word = T.forecast_by_time(df, "when", "y", ["k"], period="season", order_by=["no"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in by_word} == {"a": 10, "b": 10, "c": 10, None: 10}


def test_flat_metric_is_changed(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d}", 7.0, float(d)) for d in range(1, 9)], "day string, flag double, sales double")
    assert T.forecast_by_time(df, "day", "flag", horizon=1).first()["forecast"] == pytest.approx(9.0)
    assert T.forecast_by_time(df, "day", "flag", horizon=1, switch=False).count() == 0
    assert T.forecast_by_order(df, ["day"], "flag", horizon=1).first()["forecast"] == pytest.approx(9.0)
