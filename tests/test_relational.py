"""Ordering, filters, joins, registry and names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import ordering as O
from sextant.operators import relational as R
from sextant.operators.joinkeys import discover_join_keys
from sextant.operators.difference import table_diff
from sextant.sources.csv import EmptySourceError, read_csv
from sextant.sources.names import clean_name, table_name, unique_names
from sextant.sources.registry import TableRegistry, same_content


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows, with heavy ties in the leading order column."""
    rng = random.Random(3)
    data = [("hot" if i % 5 < 2 else f"k{i % 9}", rng.randrange(12), i) for i in range(3000)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t int, i int").repartition(8).cache()


def expected_order(data):
    groups = {}
    for k, t, i in data:
        groups.setdefault(k, []).append((t, i))
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_number_rows_within_a_hot_group(skewed, limit):
    data, df = skewed
    numbered = O.number_rows(df, ["t", "i"], ["k"], "no", limit)
    found = {(r["k"], r["t"], r["i"]): r["no"] for r in numbered.collect()}
    assert len(found) == len(data)
    for k, rows in expected_order(data).items():
        assert [found[(k, *row)] for row in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_number_rows_of_the_whole_table(skewed, limit):
    data, df = skewed
    found = {(r["t"], r["i"]): r["no"] for r in O.number_rows(df, ["t", "i"], (), "no", limit).collect()}
    ordered = sorted((t, i) for _, t, i in data)
    assert [found[row] for row in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_previous_value_crosses_slices(skewed, limit):
    data, df = skewed
    found = {(r["k"], r["i"]): r["before"] for r in O.with_previous(df, ["t", "i"], "i", "before", ["k"], limit).collect()}
    for k, rows in expected_order(data).items():
        before = [None] + [i for _, i in rows[:-1]]
        assert [found[(k, i)] for _, i in rows] == before


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_factorize_by_first_appearance(spark, limit):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c")], "i int, x string")
    codes = {r["i"]: r["code"] for r in R.factorize(df, "x", ["i"], "code", limit).collect()}
    assert codes == {1: 0, 2: 1, 3: -1, 4: 0, 5: 2}


def test_gap_and_index(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + dt.timedelta(days=d)) for i, d in enumerate([0, 1, 4])], "i int, ts timestamp")
    gaps = {r["i"]: r["gap_days"] for r in R.event_gaps(df, "ts", ["i"]).collect()}
    assert gaps == {0: None, 1: 1.0, 2: 3.0}
    index = {r["i"]: (r["event_no"], r["elapsed_days"]) for r in R.event_index(df, "ts", ["i"]).collect()}
    assert index == {0: (1, 0.0), 1: (2, 1.0), 2: (3, 4.0)}


def test_season_ranking_skips_short_season(spark):
    rows = [("2022/23", c, g) for c, g in [("La Liga", 2)] * 10 + [("UCL", 3)] * 8 + [("Copa", 1)] * 5 + [("Friendly", 0)] * 2]
    rows += [("2021/22", "La Liga", 9)] * 8
    df = spark.createDataFrame(rows, "season string, competition string, goals int")
    kept = R.qualifying_groups(df, ["season"], F.count("*") > 20)
    grain = kept.groupBy("season", "competition").agg(F.avg("goals").alias("avg_goals"))
    top = R.top_n_per_group(grain, ["season"], "avg_goals", 3, ["competition"])
    assert [(r["competition"], r["rnk"]) for r in top.orderBy("rnk").collect()] == [("UCL", 1), ("La Liga", 2), ("Copa", 3)]


def test_ranking_ties(spark):
    df = spark.createDataFrame([("g", 5), ("g", 5), ("g", 4), ("g", 3)], "g string, m int")
    assert R.top_n_per_group(df, ["g"], "m", 2, ranking="rank").count() == 2
    assert R.top_n_per_group(df, ["g"], "m", 2, ranking="dense_rank").count() == 3


def test_group_aggregate_drops_text_cells(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "3"), (None, "9")], "g string, m string")
    assert [tuple(r) for r in R.group_aggregate(df, "g", "m", "sum").collect()] == [("b", 3.0), ("a", 1.0)]


def test_equal_or_contains(spark):
    df = spark.createDataFrame([("North", 1), ("North East", 1), ("South", 2)], "region string, store int")
    assert R.equal_or_contains(df, [("region", "north")]).count() == 1
    assert R.equal_or_contains(df, [("region", "east")]).count() == 1
    assert R.equal_or_contains(df, [("region", "th"), ("store", 1)]).count() == 2
    notes = [tuple(r) for r in R.filter_notes(df, [("region", "th"), ("store", "2")]).orderBy("step").collect()]
    assert notes == [(1, "region", "th", 3, 3), (2, "store", "2", 3, 1)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "g string, x double")
    assert {r["g"]: r["pct_of_total"] for r in R.share_of_total(df, ["g"], "x").collect()} == {"a": 75.0, "b": 25.0}
    empty = R.share_of_total(df.where("x > 9"), ["g"], "x")
    assert empty.count() == 0


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(1)
    values = [rng.uniform(-50, 50) for _ in range(300)]
    bands = [(i, lo, lo + rng.uniform(0, 30)) for i, lo in enumerate(rng.uniform(-60, 40) for _ in range(20))]
    left = spark.createDataFrame([(v,) for v in values], "v double")
    right = spark.createDataFrame(bands, "b int, low double, high double")
    found = R.band_join(left, right, "v", "low", "high", 7.0).count()
    assert found == sum(lo <= v < hi for v in values for _, lo, hi in bands)


def test_table_diff(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i int, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, s string")
    assert {(r["i"], r["n_left"], r["n_right"]) for r in table_diff(a, b).collect()} == {(1, 2, 1), (3, 0, 1)}
    assert not same_content(a, b)
    assert same_content(a, a.orderBy(F.desc("i")))


# -- join keys --------------------------------------------------------------


def test_join_keys(spark):
    matches = spark.createDataFrame([(1, 2), (1, 1), (2, 0), (3, 1)], "competition_id int, goals int")
    competitions = spark.createDataFrame([(1.0, "La Liga"), (2.0, "UCL"), (9.0, "Copa")], "competition_id double, competition string")
    found = discover_join_keys(spark, {"matches": matches, "competitions": competitions}).collect()
    assert [(r["left_column"], r["overlap"], r["id_like"]) for r in found] == [("competition_id", 0.667, True)]


def test_join_keys_thresholds_and_similar_names(spark):
    a = spark.createDataFrame([(i, i) for i in range(100)], "size int, cust_key int")
    b = spark.createDataFrame([(i + 95, i) for i in range(100)], "size int, custkey int")
    found = {(r["left_column"], r["right_column"]): r["overlap"] for r in discover_join_keys(spark, {"a": a, "b": b}).collect()}
    assert found == {("cust_key", "custkey"): 1.0}


def test_join_keys_over_many_tables(spark):
    tables = {f"t{i}": spark.range(i, i + 3).withColumnRenamed("id", "key") for i in range(70)}
    found = discover_join_keys(spark, {k: tables[k] for k in list(tables)}, None)
    pairs = {(r["left_table"], r["right_table"]): r["overlap"] for r in found.where("overlap > 0").collect()}
    assert len(pairs) == 69 + 68
    assert pairs[("t62", "t63")] == 0.667 and pairs[("t60", "t62")] == 0.333


# -- names, files and registry ----------------------------------------------


def test_clean_names():
    assert [clean_name(x) for x in (" A b ", "2nd", "a--b", "", "__x__", "Sales ($)")] == [
        "a_b", "col_2nd", "ab", "column", "x", "sales",
    ]
    assert unique_names(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"]
    assert len(set(unique_names(["a", "a", "a_1"]))) == 3
    assert table_name("2024 Sales.csv") == "t_2024_sales_csv"
    assert table_name("x" * 90) == "x" * 90


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "Order ID,Sold On,Amount,Amount,Note\n1,13/03/2024,1.5,7,a\n2,2024-03-20,NA,8,b\n3,2024-04-01,2.5,9,\n"
        "4,2024-04-02,3.5,10,n/a\n5,2024-04-03,4.5,11,e\n"
    )
    df = read_csv(spark, str(path))
    assert df.dtypes == [
        ("order_id", "bigint"), ("sold_on", "timestamp"), ("amount", "double"), ("amount_1", "bigint"), ("note", "string"),
    ]
    assert df.where("note is null").count() == 2
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    with pytest.raises(EmptySourceError):
        read_csv(spark, str(empty))


def test_registry(spark, tmp_path):
    registry = TableRegistry(spark)
    one = spark.createDataFrame([(1, "a")], "ID int, Name string")
    other = spark.createDataFrame([(1, "b")], "ID int, Name string")
    assert registry.register("My Table", one) == "my_table"
    assert registry.register("My Table", one) == "my_table"
    assert registry.register("My Table", other) == "my_table_2"
    assert registry.select("select name from my_table_2 where id = :i", {"i": 1}).first()[0] == "b"
    assert registry.primary().columns == ["id", "name"]
    assert registry.row_count("absent") == 0 and registry.schema("absent").count() == 0
    assert [r["type"] for r in registry.schema("my_table").collect()] == ["int", "string"]
    with pytest.raises(ValueError, match="forbidden"):
        registry.select("drop table my_table")
    kinds = {r["kind"] for r in registry.describe().collect()}
    assert kinds == {"rows", "column", "join"}
    registry.save("my_table", str(tmp_path / "out"))
    assert registry.load([str(tmp_path / "out")]) == ["user_data"]


def test_bands_without_end(spark):
    inf = float("inf")
    values = [-1e308, -5.0, 0.0, 3.0, 1e300, inf, -inf, float("nan"), None]
    limits = [(-inf, 0.0), (0.0, inf), (-inf, inf), (2.0, 4.0), (1e299, 1e301), (inf, inf), (None, 1.0), (5.0, 2.0)]
    left = spark.createDataFrame([(v,) for v in values], "v double")
    right = spark.createDataFrame(limits, "low double, high double")
    expected = sorted((v, a, b) for v in values[:-2] for a, b in limits if a is not None and a <= v < b)
    for width in (1e-3, 1.0, 1e6):
        assert sorted(map(tuple, R.band_join(left, right, "v", "low", "high", width).collect())) == expected
