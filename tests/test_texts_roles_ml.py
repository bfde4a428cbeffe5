"""Chunks, retrieval, rules, roles, insights and models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions.chunking import overlapping_chunks, split_text
from sextant.functions.similarity import alike, label_ratio
from sextant.operators import audit as A
from sextant.operators import insights as I
from sextant.operators import ml, roles
from sextant.operators import retrieval as N
from sextant.operators import texts as X


def test_paragraphs_are_packed_by_line():
    assert list(split_text("one\n\ntwo\n \nthree", 9)) == ["one\ntwo", "three"]
    assert list(split_text("  \n\n ", 9)) == []


def test_long_words_stay_whole_and_flush():
    long = "x" * 30
    assert list(split_text(f"short\n\naa bb {long} cc\n\nend", 12)) == ["short", "aa bb", long, "cc", "end"]


def test_overlap():
    chunks = overlapping_chunks("a" * 400 + "\n\n" + "b" * 400, 500, 50)
    assert chunks == ["a" * 400, "a" * 50 + " " + "b" * 400]
    assert overlapping_chunks(None) == []


def test_chunks_of_documents(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None), (5, "tiny")], "doc_id bigint, text string")
    chunks = X.chunk_documents(df, "doc_id", "text").collect()
    assert len({c["id"] for c in chunks}) == len(chunks)
    first = sorted((c["chunk_index"], c["text"]) for c in chunks if c["doc_id"] == 1)
    assert [i for i, _ in first] == list(range(len(first))) and all(len(t) <= 551 for _, t in first)
    plain = list(split_text(text, 500))
    assert " ".join(plain) == text and len(plain) == len(first)
    assert first[0][1] == plain[0]
    for before, own, (_, found) in zip(plain, plain[1:], first[1:]):
        assert found == f"{before[-50:]} {own}".strip()
    assert {c["doc_id"] for c in chunks} == {1, 2, 5}


def test_upsert(spark):
    current = spark.createDataFrame([("a", "old", 9), ("b", "kept", 1)], "id string, text string, version int")
    incoming = spark.createDataFrame([("a", "new", 1), ("a", "newer", 2)], "id string, text string, version int")
    assert {r["id"]: r["text"] for r in X.upsert_chunks(current, incoming).collect()} == {"a": "newer", "b": "kept"}


def test_exchange_text(spark):
    row = spark.range(1).select(X.exchange_text(F.lit("q"), F.lit("a"), F.lit("sql"), F.lit("select 1")).alias("t")).first()
    assert row["t"] == "[SQL]\nQuestion: q\nAnswer: a\nDetails: select 1"


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [2048, 3])
def test_nearest_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(200, 8)).astype("float32").astype("float64")
    matrix[120:190] = matrix[7]  # a group of copies: ties go to the smaller id
    queries = matrix[[7, 50, 60, 3, 9]] + 0.01
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id bigint, embedding array<double>")
    found = N.nearest(vectors.repartition(5), asked, 4, metric, block).collect()
    for q, query in enumerate(queries):
        if metric == "l2":
            d = ((matrix - query) ** 2).sum(axis=1)
        else:
            d = 1 - matrix @ query / np.linalg.norm(matrix, axis=1) / np.linalg.norm(query)
        expected = np.lexsort((np.arange(200), np.round(d, 9)))[:4]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == list(expected)


def test_nearest_with_text_ids_nulls_and_a_repeated_id(spark):
    vectors = spark.createDataFrame(
        [(f"v{i}", [float(i), 0.0]) for i in range(50)] + [("none", None)], "vec_id string, embedding array<double>"
    )
    asked = spark.createDataFrame(
        [("a", [3.2, 0.0]), ("a", [40.1, 0.0]), ("b", None)], "query_id string, embedding array<double>"
    )
    found = N.nearest(vectors, asked, 1, block=1, shard_rows=7)
    assert sorted((r["query_id"], r["vec_id"]) for r in found.collect()) == [("a", "v3"), ("a", "v40")]


def test_nearest_with_many_queries(spark):
    vectors = spark.range(40).selectExpr("id as vec_id", "array(double(id), 1D) as embedding")
    asked = spark.range(10_000).selectExpr("if(id < 5000, -1, id) as query_id", "array(double(id % 40), 1D) as embedding")
    found = N.nearest(vectors, asked, 2)
    assert found.where("rank = 1 and distance = 0").count() == 10_000 and found.where("rank = 2").count() == 10_000


def test_citations(spark):
    hits = spark.createDataFrame([(0, 1, 1)], "query_id int, vec_id int, rank int")
    texts = spark.createDataFrame([(1, "ml", "x" * 201)], "vec_id int, source_type string, text string")
    assert X.citations(hits, texts).first()["excerpt"] == "x" * 200 + "..."


def test_findings(spark):
    df = spark.createDataFrame(
        [(1, "ml", "first", True), (2, "ml", "last", True), (3, "ml", "broken", False), (1, "sql", "only", True)],
        "seq int, agent string, summary string, success boolean",
    )
    found = {r["agent"]: (r["n_findings"], r["last_summary"]) for r in X.findings_rollup(df).collect()}
    assert found == {"ml": (2, "last"), "sql": (1, "only")}


ROUTED = {
    "How many rows are there?": "sql",
    "Train a model to predict churn": "ml",
    "What were the key findings?": "rag",
    "Show me a data quality report": "quality",
    "Is there a significant difference in revenue between regions?": "stats",
    "Forecast next month's revenue": "forecast",
    "Generate a report of my analysis": "report",
    "Are there any outliers I should know about?": "stats",
    "What's correlated with churn?": "stats",
    "Suggest what to explore": "insight",
    "hello": "unlabelled",
}


def test_routing(spark):
    df = spark.createDataFrame([(q,) for q in ROUTED], "q string")
    assert {r["q"]: r["route"] for r in A.route_questions(df, "q").collect()} == ROUTED
    without = A.route_questions(df, "q", has_data=False)
    assert without.where("q like 'How many%'").first()["route"] == "unlabelled"


STATEMENTS = {
    "SELECT * FROM user_data": "ok",
    "INSERT INTO user_data VALUES (1)": "forbidden_word",
    "DROP TABLE user_data": "forbidden_word",
    "SELECT 1; DROP TABLE user_data": "forbidden_word",
    "WITH r AS (SELECT a, RANK() OVER (PARTITION BY b ORDER BY c) AS rnk FROM s) SELECT * FROM r WHERE rnk <= 2": "ok",
    "SELECT * FROM sales;": "ok",
    "SELECT last_update FROM sales": "ok",
    "SELECT 1; SELECT 2": "multiple_statements",
    "-- drop\nselect 1": "ok",
    "/* delete\n all */ select 1": "ok",
    "EXPLAIN SELECT 1": "not_select",
    "  ": "empty",
}


def test_sql_audit(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "s string")
    assert {r["s"]: r["reason"] for r in A.audit_sql(df, "s").collect()} == STATEMENTS
    assert {s: A.is_read_only(s)[1] or "ok" for s in STATEMENTS} == STATEMENTS


def test_sql_coverage(spark):
    top = "For each season, show the top 3 competitions by average goals per match, only for seasons with more than 20 matches"
    share = "What percentage of total revenue does each region contribute?"
    cases = [
        (top, "SELECT season, AVG(goals) FROM t GROUP BY season", ["needs_window", "needs_having"]),
        (top, "WITH ok AS (SELECT season FROM t GROUP BY season HAVING COUNT(*) > 20) SELECT *, ROW_NUMBER() OVER "
              "(PARTITION BY season ORDER BY g) AS rnk FROM c WHERE rnk <= 3", []),
        (share, "SELECT region, SUM(revenue) FROM t GROUP BY region", ["needs_total", "needs_share"]),
        ("Show the top 5 users", "SELECT u FROM t", ["needs_limit"]),
        ("Show the top 5 users", "SELECT u FROM t LIMIT 5", []),
    ]
    df = spark.createDataFrame([(i, q, s) for i, (q, s, _) in enumerate(cases)], "i int, q string, s string")
    found = {r["i"]: r["issues"] for r in A.audit_coverage(df, "q", "s").collect()}
    assert found == {i: issues for i, (_, _, issues) in enumerate(cases)}


def test_similarity(spark):
    assert alike("usa", "us") and not alike("usa", "unitedstates") and not alike("", "a")
    df = spark.createDataFrame([("abcd", "bcde"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(label_ratio("a", "b")).collect()] == [0.75, None]


# -- roles and insights -----------------------------------------------------


@pytest.fixture(scope="module")
def churn(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        tenure = rng.randrange(1, 60)
        monthly = 20 + rng.random() * 80
        contract = rng.choice(["Month-to-month", "One year", "Two year"])
        leaves = "Yes" if contract == "Month-to-month" and tenure < 25 else "No"
        rows.append((i, tenure, monthly, monthly * tenure, contract, leaves))
    return spark.createDataFrame(
        rows, "customer_id int, tenure_months int, monthly_charges double, total_charges double, contract_type string, churn string"
    ).cache()


def test_roles(churn):
    found = {r["column"]: r for r in roles.column_roles(churn).collect()}
    assert found["churn"]["default_target"] and found["customer_id"]["dimension_name"]
    assert found["monthly_charges"]["default_metric"] or found["total_charges"]["default_metric"]
    assert roles.task_type(churn, "churn") == "classification"
    assert roles.task_type(churn, "total_charges") == "regression"
    assert roles.task_type(churn, None) == "clustering"
    assert roles.default_test_pair(churn)[0] == "churn"


def test_groupings(churn):
    rows = roles.suggested_groupings(churn).orderBy("position").collect()
    assert [r["group_col"] for r in rows] == ["churn"] * 3 and "charges" in rows[0]["metric_col"]


def test_date_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "x1", 5)] * 4, "match_date string, code string, n int")
    assert [r["column"] for r in roles.date_column_scores(df).collect()] == ["match_date"]


def test_insights(churn):
    rows = I.insights(churn).orderBy("position").collect()
    assert 3 <= len(rows) <= 5
    assert rows[0]["kind"] == "correlation" and {r["kind"] for r in rows} >= {"comparison", "modeling"}


def test_explore(churn, spark):
    sections = I.explore(churn)
    assert {"missing", "describe", "correlation", "value_counts", "groupings"} <= set(sections)
    assert sections["describe"].count() == 4
    assert any(name.startswith("groupby:") for name in sections)
    tiny = I.explore(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert tiny["describe"].first()["count"] == 1


# -- models -----------------------------------------------------------------


def test_preparation(spark):
    df = spark.createDataFrame(
        [(i, f"free text {i}", "2024-01-%02d" % (i % 28 + 1), None if i % 10 == 0 else float(i), None if i % 7 == 0 else "k")
         for i in range(100)],
        "row_id int, note string, day string, x double, kind string",
    )
    f = ml.prepare_features(df)
    assert set(f.dropped) == {"row_id", "note"}
    assert set(f.numeric) == {"x", "day_month", "day_dow", "day_year"} and f.categorical == ["kind"]
    assert f.data.where("x is null or kind is null").count() == 0


def test_rare_labels_are_pooled(spark):
    df = spark.range(1000).selectExpr("concat('v', cast(floor(sqrt(id)) as int)) as c")
    pooled = ml.pool_rare(df, ["c"])
    assert pooled.select("c").distinct().count() == 20 and pooled.where("c = 'infrequent'").count() > 0
    assert pooled.count() == 1000


@pytest.mark.parametrize("one_task_rows", [2_000_000, 100])
def test_split_is_stratified_and_repeatable(spark, one_task_rows):
    df = spark.range(2000).selectExpr("id", "if(id % 10 = 0, 'rare', 'common') as y").unionByName(
        spark.createDataFrame([(5000, "pair"), (5001, "pair"), (5002, "single")], "id bigint, y string")
    )
    split = ml.stratified_split(df, "y", ["id"], one_task_rows=one_task_rows)
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sum(counts.values()) == 2003
    assert counts[("common", "test")] == 360
    assert counts[("rare", "test")] == 40 and counts[("pair", "test")] == 1 and counts[("single", "train")] == 1
    again = ml.stratified_split(df.repartition(5), "y", ["id"], one_task_rows=one_task_rows)
    assert split.exceptAll(again).count() == 0


def test_classification(churn):
    f = ml.prepare_features(churn, "churn", keep=["customer_id"])
    trained = ml.train_models(f, "classification", ["customer_id"], ("linear", "forest"))
    board = trained.leaderboard.orderBy("rank").collect()
    assert len(board) == 6 and board[0]["f1"] > 0.85 and board[0]["f1"] >= board[-1]["f1"]
    names = {r["feature"] for r in trained.importances.collect()}
    assert "tenure_months" in names and any(n.startswith("contract_type") for n in names)


def test_regression_and_automl(churn):
    result = ml.automl(churn.drop("churn", "contract_type"), ["customer_id"], target="total_charges", task=None)
    assert result.task == "regression"
    board = result.leaderboard.orderBy("rank").collect()
    assert len(board) == 10 and board[0]["r2"] > 0.9 and board[0]["rmse"] <= board[-1]["rmse"]


def test_clustering(churn):
    assert [ml.cluster_number(n) for n in (4, 9, 16, 1000)] == [2, 2, 3, 5]
    result = ml.automl(churn.select("customer_id", "tenure_months", "monthly_charges"), ["customer_id"], task="clustering")
    rows = result.leaderboard.collect()
    assert sum(r["n_rows"] for r in rows) == 240 and -1 <= rows[0]["silhouette"] <= 1


def test_risk_flags():
    assert ml.risk_flags(20, 30, "classification", {"accuracy": 1.0}) == [
        "small_data", "suspiciously_high", "near_perfect", "more_features_than_rows",
    ]
    assert ml.risk_flags(500, 3, "regression", {"r2": 0.99}) == []


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    assert [tuple(r) for r in ml.zscore(df, ["x", "flat"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_encoding_and_principal_coordinates(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i), "ab"[i % 2]) for i in range(10)], "k int, x double, y double, c string")
    f = ml.prepare_features(df, keep=["k"])
    encoded = {r["k"]: r["features"] for r in ml.encoded_features(f).collect()}
    matrix = np.array([encoded[i] for i in range(10)])
    assert matrix[:, :2].mean(axis=0) == pytest.approx([0, 0], abs=1e-12)
    assert matrix[:, :2].std(axis=0, ddof=1) == pytest.approx([1, 1])
    assert [list(v[2:4]) for v in matrix[:2]] == [[1.0, 0.0], [0.0, 1.0]]
    places = np.array([[r["pc1"], r["pc2"]] for r in ml.pca_2d(f).orderBy("k").collect()])
    assert places[:, 0].var() > places[:, 1].var()
    assert abs(np.corrcoef(places[:, 0], np.arange(10))[0, 1]) > 0.9
