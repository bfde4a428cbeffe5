"""Ranked suggestions of what to look at next, and the full exploratory profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import categorical_columns, numeric_columns, text_columns
from sextant.operators import profile, relational, roles
from sextant.operators.frequencies import cardinalities, columns_within, value_counts_topk

# Name parts of preferred metrics and of outcome columns.
METRIC_NAME_PARTS = ["goal", "price", "revenue", "charge", "amount", "sales", "churn"]
OUTCOME_NAME_PARTS = ["churn", "price", "goal", "target", "label", "outcome"]


def insights(df: DataFrame, limit: int = 5) -> DataFrame:
    """Three to five rows (position, kind, column_a, column_b, value), most telling kind first."""
    spark = df.sparkSession
    numbers, categories = numeric_columns(df), categorical_columns(df)
    parts: list[DataFrame] = []

    def fixed(priority: int, kind: str, a: str | None, b: str | None) -> DataFrame:
        return spark.createDataFrame(
            [(priority, 0, kind, a, b, None)],
            "priority int, place int, kind string, column_a string, column_b string, value double",
        )

    if len(numbers) > 1:
        pairs = profile.corr_pairs(df, numbers, top=2)
        place = F.row_number().over(W.orderBy(F.desc(F.abs("r")), "col_a", "col_b"))  # two rows
        parts.append(
            pairs.select(
                F.lit(1).alias("priority"), place.alias("place"), F.lit("correlation").alias("kind"),
                F.col("col_a").alias("column_a"), F.col("col_b").alias("column_b"), F.col("r").alias("value"),
            )
        )
    if categories and numbers:
        distinct = cardinalities(df, columns_within(df, categories, 20))
        category = min(categories, key=lambda c: distinct[c] if distinct.get(c, 0) >= 2 else 999)
        metric = next((n for p in METRIC_NAME_PARTS for n in numbers if p in n.lower()), numbers[0])
        if 2 <= distinct.get(category, 0) <= 20:
            parts.append(fixed(2, "comparison", category, metric))
    outcome = next((c for c in df.columns if any(p in c.lower() for p in OUTCOME_NAME_PARTS)), None)
    if outcome:
        parts.append(fixed(3, "modeling", outcome, None))
    if categories and numbers:
        parts.append(fixed(4, "ranking", categories[0], numbers[0]))
    parts.append(_anomalies(df))
    heavy = profile.missing_heaviest(df)
    parts.append(
        heavy.select(
            F.lit(6).alias("priority"), F.lit(0).alias("place"), F.lit("quality").alias("kind"),
            F.col("column").alias("column_a"), F.lit(None).cast("string").alias("column_b"), F.col("pct").alias("value"),
        )
    )
    found = reduce(DataFrame.unionByName, parts)
    # A handful of rows from here on.
    same = W.partitionBy("kind", "column_a", "column_b").orderBy("priority", "place")
    first = found.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    padded = first.unionByName(fixed(9, "eda", None, None))
    ranked = padded.withColumn("position", F.row_number().over(W.orderBy("priority", "place", "column_a")).cast("bigint"))
    enough = F.col("position") <= F.when(F.col("kind") == "eda", 3).otherwise(limit)
    return ranked.where(enough).select("position", "kind", "column_a", "column_b", "value")


def _anomalies(df: DataFrame, limit: int = 2) -> DataFrame:
    """First anomalies in column order: spikes and dips before dominant categories."""
    order = {c: i for i, c in enumerate(df.columns)}
    place = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    spikes = profile.spike_dip(df).select(
        "kind", F.col("column").alias("column_a"), F.col("n_flagged").cast("double").alias("value"),
        (place[F.col("column")] * 2 + F.when(F.col("kind") == "dip", 1).otherwise(0)).alias("place"),
    )
    dominant = profile.imbalance(df, text_columns(df)).select(
        F.lit("imbalance").alias("kind"), F.col("column").alias("column_a"), F.col("top_share").alias("value"),
        (F.lit(2 * len(order)) + place[F.col("column")]).alias("place"),
    )
    return (
        spikes.unionByName(dominant)
        .orderBy("place")
        .limit(limit)
        .select(
            F.lit(5).alias("priority"), F.col("place").cast("int").alias("place"), "kind", "column_a",
            F.lit(None).cast("string").alias("column_b"), "value",
        )
    )


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """Exploratory profile: one lazy frame per section."""
    numbers, categories = numeric_columns(df), categorical_columns(df)
    sections = {"missing": profile.missing_profile(df), "date_columns": roles.date_column_scores(df)}
    if numbers:
        sections["describe"] = profile.describe(df)
    if len(numbers) > 1:
        sections["correlation"] = profile.corr_matrix(df)
    if categories:
        sections["value_counts"] = value_counts_topk(df, categories, 15)
        sections["choices"] = value_counts_topk(df, categories, 20)
    for c in numbers:
        sections[f"histogram:{c}"] = profile.histogram(df, c)
    if numbers and categories:
        groupings = roles.suggested_groupings(df)
        sections["groupings"] = groupings
        for g in groupings.collect():  # at most three rows
            name = f"groupby:{g['metric_col']}_by_{g['group_col']}"
            sections[name] = relational.group_aggregate(df, g["group_col"], g["metric_col"])
    best = sections["date_columns"].first()  # one row per candidate column
    if best is not None and best["is_timestamp"]:
        for c in numbers:
            sections[f"timeseries:{c}"] = relational.time_series_mean(df, best["column"], c)
    return sections
