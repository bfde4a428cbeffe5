"""What each column is for: dates, metrics, dimensions, targets, groupings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.columns import (
    categorical_columns,
    empty_like,
    is_numeric,
    numeric_columns,
    quoted,
    rows_from_wide,
    text_columns,
    time_columns,
)
from sextant.functions.dates import looks_like_date, parse_mixed_date, strip_null_tokens
from sextant.operators.frequencies import cardinalities, columns_within
from sextant.operators.profile import variance_rank

# Name parts that hint at a column's role.
DATE_NAME_PARTS = ["date", "time", "month", "year", "day", "period", "timestamp", "match"]
STRONG_DATE_NAME_PARTS = ["date", "time", "match", "period"]
METRIC_NAME_PARTS = [
    "weekly_sales", "sales", "revenue", "goal", "goals", "amount", "price",
    "charges", "income", "value", "count", "total", "score", "profit", "units",
    "demand", "volume", "qty", "quantity", "orders",
]
DIMENSION_NAME_PARTS = [
    "store", "region", "country", "city", "state", "branch", "shop", "id",
    "flag", "code", "sku", "category", "segment", "dept", "department",
    "type", "class", "group", "zone", "index",
]
NEVER_DIMENSION_PARTS = ["sales", "revenue", "goal", "amount", "price"]
TARGET_NAME_PARTS = [
    "target", "label", "class", "outcome", "churn", "survived",
    "price", "salary", "income", "revenue", "sales", "amount",
    "score", "rating", "default", "fraud", "diagnosis",
]
KPI_NAME_PARTS = ["price", "revenue", "sales", "amount", "charge", "income"]
TEST_METRIC_NAME_PARTS = ["revenue", "sales", "amount", "price", "charges", "income", "value"]


def _mentions(name: str, parts: Sequence[str]) -> bool:
    return any(part in name.lower() for part in parts)


def is_dimension_name(name: str) -> bool:
    return _mentions(name, DIMENSION_NAME_PARTS) and not _mentions(name, NEVER_DIMENSION_PARTS)


def is_metric_name(name: str) -> bool:
    squeezed = re.sub("[^a-z0-9]", "", name.lower())
    return _mentions(name, METRIC_NAME_PARTS) or squeezed in METRIC_NAME_PARTS


def date_column_scores(df: DataFrame) -> DataFrame:
    """Columns that can serve as time axis, best first: a real timestamp, else by parse rate.

    All candidates are measured in one aggregate over all rows.
    """
    times, texts = time_columns(df), text_columns(df)
    named = [c for c in df.columns if _mentions(c, DATE_NAME_PARTS)]
    candidates = [c for c in df.columns if c in times or c in texts or c in named]
    schema = "column string, is_timestamp boolean, n_non_null bigint, n_parsed bigint, shaped double, score double"
    if not candidates:
        return empty_like(df, schema)
    aggs, records = [], []
    for i, c in enumerate(candidates):
        if c in times:
            filled = parsed = shaped = F.count(quoted(c))
        else:
            cell = strip_null_tokens(quoted(c).cast("string"))
            filled, parsed, shaped = F.count(cell), F.count(parse_mixed_date(cell)), F.count_if(looks_like_date(cell))
        aggs += [filled.alias(f"f{i}"), parsed.alias(f"p{i}"), shaped.alias(f"s{i}")]
        rate = F.try_divide(F.col(f"p{i}"), F.col(f"f{i}"))
        bonus = 0.2 if _mentions(c, STRONG_DATE_NAME_PARTS) else 0.0
        records.append(
            [
                F.lit(c).alias("column"),
                F.lit(c in times).alias("is_timestamp"),
                F.col(f"f{i}").alias("n_non_null"),
                F.col(f"p{i}").alias("n_parsed"),
                F.try_divide(F.col(f"s{i}"), F.col(f"f{i}")).alias("shaped"),
                (rate + bonus).alias("score"),
                rate.alias("_rate"),
            ]
        )
    usable = F.col("is_timestamp") | ((F.col("shaped") >= 0.4) & (F.col("n_parsed") >= 3) & (F.col("_rate") > 0.5))
    return (
        rows_from_wide(df.agg(*aggs), records)
        .where(usable)
        .orderBy(F.desc("is_timestamp"), F.desc("score"), "column")
        .drop("_rate")
    )


def metric_score(name: str) -> int:
    score = sum(part in name.lower() for part in METRIC_NAME_PARTS)
    if is_dimension_name(name):
        return score - 8
    return score + 2 if is_metric_name(name) else score


def default_metric(df: DataFrame, exclude: Sequence[str] = ()) -> str | None:
    """Best-named measure; without one, the numeric column of largest variance."""
    numbers = [c for c in numeric_columns(df) if c not in exclude]
    if not numbers:
        return next((c for c in df.columns if c not in exclude and is_metric_name(c)), None)
    best = max(numbers, key=metric_score)
    if metric_score(best) >= 2:
        return best
    top = variance_rank(df, numbers).where("rank = 1").first()  # one row
    return top["column"] if top["variance"] > 0 else best


def default_target(df: DataFrame, distinct: dict[str, int] | None = None) -> str | None:
    """Column to predict: by name, else the only category, else the only numeric with 2 to 10 values."""
    for c in df.columns:
        if _mentions(c, TARGET_NAME_PARTS):
            return c
    categories = categorical_columns(df)
    if len(categories) == 1:
        return categories[0]
    numbers = numeric_columns(df)
    distinct = distinct or cardinalities(df, columns_within(df, numbers, 10))
    few = [c for c in numbers if 2 <= distinct.get(c, 0) <= 10]
    return few[0] if len(few) == 1 else None


def task_type(df: DataFrame, target: str | None, distinct: dict[str, int] | None = None) -> str:
    if target is None:
        return "clustering"
    if is_numeric(df, target):
        distinct = distinct or cardinalities(df, columns_within(df, [target], 10))
        # A column left out of the exact count has many values.
        if distinct.get(target, 11) > 10:
            return "regression"
    return "classification"


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: kind, name hints, distinct values, and whether it is the default metric or target."""
    distinct = cardinalities(df, df.columns)
    metric, target = default_metric(df), default_target(df, distinct)
    numbers, texts, times = numeric_columns(df), categorical_columns(df), time_columns(df)
    rows = []
    for c in df.columns:
        kind = "numeric" if c in numbers else "categorical" if c in texts else "time" if c in times else "other"
        rows.append(
            (c, kind, distinct[c], is_metric_name(c), is_dimension_name(c), c == metric, c == target)
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, kind string, n_distinct bigint, metric_name boolean, dimension_name boolean, "
        "default_metric boolean, default_target boolean",
    )


def suggested_groupings(df: DataFrame, limit: int = 3, max_levels: int = 30) -> DataFrame:
    """Up to three (category, metric) pairs: fewest levels first, KPI-named metrics first.

    Every pair is of the first category unless the metrics run out, so values
    are counted only of metrics that can come so early.
    """
    numbers, categories = numeric_columns(df), categorical_columns(df)
    named = [c for c in numbers if _mentions(c, KPI_NAME_PARTS)]
    numbers = named if len(named) >= limit else numbers
    few = columns_within(df, categories, max_levels)
    distinct = cardinalities(df, numbers + few) if few else {}
    place = {c: i for i, c in enumerate(df.columns)}
    categories, numbers = few, numbers if few else []
    metrics = sorted(numbers, key=lambda c: (not _mentions(c, KPI_NAME_PARTS), -distinct[c], place[c]))
    usable = [c for c in categories if 2 <= distinct[c] <= max_levels]
    usable.sort(key=lambda c: (distinct[c], place[c]))
    pairs = [(c, m) for c in usable for m in metrics][:limit]
    rows = [(i + 1, c, m, "mean", distinct[c]) for i, (c, m) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(
        rows, "position bigint, group_col string, metric_col string, agg string, n_levels bigint"
    )


def default_test_pair(df: DataFrame) -> tuple[str | None, str | None]:
    """Category with the fewest levels and the first well-named numeric with more than two values."""
    numbers, categories = numeric_columns(df), categorical_columns(df)
    distinct = cardinalities(df, numbers + categories)
    metrics = [c for c in numbers if distinct[c] > 2]
    group = min(categories, key=distinct.get, default=None)
    for part in TEST_METRIC_NAME_PARTS:
        for c in metrics:
            if part in c.lower():
                return group, c
    return group, metrics[0] if metrics else None
