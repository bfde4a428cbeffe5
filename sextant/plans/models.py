"""Model queries: rows only, as learned values are not SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import ml
from sextant.plans.catalog import Tables, query
from sextant.scratch import materialize


def _labelled_documents(t: Tables) -> DataFrame:
    """Facts of the labelled documents, stored, as preparation reads them many times and the texts need not be."""
    rows = t.labels.join(t.documents, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.length(F.regexp_replace("text", r"\S", "")).alias("n_spaces"), "toxic", "quality"
    )
    return materialize(rows, "labelled")


@query("encoded_features")
def encoded_features(t: Tables) -> DataFrame:
    prepared = ml.prepare_features(_labelled_documents(t), "quality", keep=["doc_id"])
    rows = ml.encoded_features(prepared)
    return rows.select("doc_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


_TICKET = f"md5(cast(doc_id as varchar) || '|{ml.SEED}')"


@query(
    "stratified_split",
    "with r as (select quality, row_number() over (partition by quality order by "
    f"{_TICKET}, doc_id) as k, count(*) over (partition by quality) as n from labels join documents using (doc_id)), "
    "s as (select quality, case when n >= 2 and k > n - ceil(0.2 * n - 1e-9) then 'test' else 'train' end as split from r) "
    "select quality, split, count(*) as n_rows from s group by quality, split",
)
def stratified_split(t: Tables) -> DataFrame:
    """Rows per label and side of the split."""
    split = ml.stratified_split(_labelled_documents(t), "quality", ["doc_id"])
    return split.groupBy("quality", "split").agg(F.count("*").alias("n_rows"))


@query("clf_leaderboard")
def clf_leaderboard(t: Tables) -> DataFrame:
    prepared = ml.prepare_features(_labelled_documents(t), "quality", keep=["doc_id"])
    return ml.train_models(prepared, "classification", ["doc_id"]).leaderboard


@query("reg_leaderboard")
def reg_leaderboard(t: Tables) -> DataFrame:
    return _order_value_models(t).leaderboard


@query("feature_importance")
def feature_importance(t: Tables) -> DataFrame:
    return _order_value_models(t).importances.where("rank <= 15")


def _order_value_models(t: Tables) -> ml.Trained:
    """Predict a customer's mean order value from the customer's own attributes and order habits."""
    habits = t.orders.groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("mean_price"),
        F.count("*").alias("n_orders"),
        F.max("o_totalprice").alias("largest"),
        F.avg(F.month("o_orderdate")).alias("mean_month"),
    )
    rows = t.customer.join(habits, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_orders", "largest", "mean_month", "mean_price"
    )
    prepared = ml.prepare_features(materialize(rows, "customers"), "mean_price", keep=["c_custkey"])
    return ml.train_models(prepared, "regression", ["c_custkey"])


def _line_features(t: Tables) -> ml.Features:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return ml.prepare_features(rows.drop("l_partkey"), keep=["l_orderkey", "l_linenumber"])


@query("kmeans_clusters")
def kmeans_clusters(t: Tables) -> DataFrame:
    _, summary = ml.kmeans_clusters(_line_features(t))
    return summary


@query("pca_2d")
def pca_2d(t: Tables) -> DataFrame:
    return ml.pca_2d(_line_features(t))


@query("automl_facts")
def automl_facts(t: Tables) -> DataFrame:
    """What was chosen and what it came to: task, target, first model of the board and reasons for distrust."""
    found = ml.automl(_labelled_documents(t), ["doc_id"], "quality")
    first = found.leaderboard.first()
    facts = [("task", found.task), ("target", found.target), ("model", first["model"]), ("flags", ",".join(found.flags))]
    return t.spark.createDataFrame(facts, "fact string, value string")
