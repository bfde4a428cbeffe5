"""Distinct values and frequent values without trusting a sketch, and without shuffling free text."""

import random
from collections import Counter

import pytest

from sextant.operators import clean, profile
from sextant.operators import frequencies as Q
from tests.test_difference import shuffled


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(9)
    rows = [
        (i, i % 90, float(i % 3), f"{i} {rng.getrandbits(1600):x}", "most" if i % 10 else f"rare {i}", None if i % 20 else "x", rng.choice("ab"))
        for i in range(20_000)
    ]
    return spark.createDataFrame(rows, "a long, b int, few double, free string, most string, gaps string, even string").repartition(6)


@pytest.mark.parametrize("forged", [None, 0, 10**9])
def test_estimates_never_decide(mixed, monkeypatch, forged):
    if forged is not None:
        monkeypatch.setattr(Q, "_estimates", lambda df, columns: dict.fromkeys(columns, forged))
    columns = ["a", "b", "few", "free", "even"]
    within = Q.columns_within(mixed, columns, 80)
    assert {"few", "even"} <= set(within)
    if forged is None:
        assert set(within) == {"few", "even", "b"}  # b is near the limit: left to the exact count
    needs = {"a": 20_000, "b": 90, "few": 3, "free": 20_001, "even": 3}
    assert Q.distinct_reaches(mixed, needs) == {"a": True, "b": True, "few": True, "free": False, "even": False}
    assert Q.distinct_reaches(mixed, {"b": 91, "free": 5}) == {"b": False, "free": True}
    flat = {r["column"]: r["low_variance"] for r in profile.low_variance(mixed).collect()}
    assert flat == {"a": False, "b": False, "few": False}
    assert {r["column"]: r["by_uniqueness"] for r in clean.id_like_columns(mixed).collect()} == {"a": True}


@pytest.mark.parametrize("share", [0.95, 0.85, 0.4, 0.05])
def test_frequent_values_equal_counting(mixed, share):
    columns = ["free", "most", "gaps", "even"]
    rows = mixed.select(*columns).collect()
    expected = set()
    for c in columns:
        expected |= {(c, v, n, 20_000) for v, n in Counter(r[c] for r in rows).items() if n >= share * 20_000}
    assert {tuple(r) for r in Q.frequent_values(mixed, columns, share).collect()} == expected


def test_imbalance_shuffles_no_free_text(spark, mixed, tmp_path):
    mixed.select("free", "most", "gaps", "even").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    before = shuffled(spark)
    found = {r["column"]: (r["top_value"], round(r["top_share"], 4), r["n_values"]) for r in profile.imbalance(stored).collect()}
    assert found == {"most": ("most", 0.9, 2001), "gaps": ("__null__", 0.95, 2)}
    used = shuffled(spark) - before
    before = shuffled(spark)
    stored.groupBy("free").count().count()
    counted = shuffled(spark) - before
    assert used < counted / 5  # sums of at most 4096 buckets a column and task, and fingerprints of dominated columns


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b int")
    assert Q.frequent_values(none, ["a", "b"], 0.5).collect() == []
    assert Q.distinct_reaches(none, {"a": 1}) == {"a": False}
    assert profile.imbalance(none).collect() == []
