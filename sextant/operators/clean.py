"""Safe automatic cleaning, suggestions, and user-confirmed label decisions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.columns import is_numeric, numeric_columns, quoted, without_nan
from sextant.functions.numbers import to_number
from sextant.operators.frequencies import distinct_reaches, value_counts_topk, value_frequencies
from sextant.operators.joins import small_side
from sextant.operators.labels import similar_label_groups
from sextant.operators.profile import duplicate_count, numbers_as_text, percent, quality_facts
from sextant.operators.quantiles import column_quantiles
from sextant.scratch import materialize


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cast_numeric_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast text columns holding numbers with thousands separators; failures become null."""
    if columns is None:
        columns = [r["column"] for r in numbers_as_text(df).select("column").collect()]  # schema-sized
    return df.select(
        *[to_number(quoted(c), thousands=True).alias(c) if c in columns else quoted(c) for c in df.columns]
    )


class CleanResult(NamedTuple):
    data: DataFrame
    log: DataFrame


LOG_SCHEMA = "step bigint, action string, column string, n_cells bigint, fill string"


def auto_clean(df: DataFrame) -> CleanResult:
    """Drop exact duplicates, cast numbers held as text, then fill gaps.

    Numeric gaps get the median, others the most frequent value or "Unknown".
    Outliers are kept and labels are never merged. The duplicate-free rows are
    written once because the statistics and the result both read them; the fill
    values are literals, one per column.
    """
    df = without_nan(df)
    before = df.count()
    distinct = materialize(drop_duplicates(df), "distinct")
    after = distinct.count()
    log: list[tuple] = []
    if after < before:
        log.append(("drop_duplicates", None, before - after, None))
    as_text = [r["column"] for r in numbers_as_text(distinct).select("column").collect()]
    as_text = [c for c in distinct.columns if c in as_text]
    cast = cast_numeric_text(distinct, as_text)
    log += [("cast_to_number", c, None, None) for c in as_text]

    counts = cast.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(cast.columns)]).first()
    missing = {c: after - counts[f"c{i}"] for i, c in enumerate(cast.columns) if counts[f"c{i}"] < after}
    numeric = [c for c in missing if is_numeric(cast, c)]
    other = [c for c in missing if c not in numeric]
    medians = column_quantiles(cast, numeric, (0.5,))
    modes = {}
    if other:
        modes = {r["column"]: r["value"] for r in value_counts_topk(cast, other, 1).collect()}  # one row per column
    fills = {}
    for c in cast.columns:
        if c in numeric:
            fill = medians[c].values[0]
            fills[c] = _median_literal(cast.schema[c].dataType, fill)
            log.append(("impute_median", c, missing[c], None if fill is None else repr(fill)))
        elif c in other:
            fill = modes.get(c)
            kind = cast.schema[c].dataType
            if fill is None and isinstance(kind, T.StringType):
                fill = "Unknown"
            fills[c] = F.lit(fill).cast(kind)
            log.append(("impute_mode", c, missing[c], fill))
    filled = cast.select(
        *[F.coalesce(quoted(c), fills[c]).alias(c) if c in fills else quoted(c) for c in cast.columns]
    )
    rows = [(i + 1, *entry) for i, entry in enumerate(log)]
    return CleanResult(filled, df.sparkSession.createDataFrame(rows, LOG_SCHEMA))


def _median_literal(kind: T.DataType, fill: float | None):
    """Keep an integer column integral when its median is whole."""
    if fill is not None and isinstance(kind, T.IntegralType) and fill == int(fill):
        return F.lit(int(fill)).cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.lit(fill).cast(kind)
    return F.lit(fill)


def merge_labels(df: DataFrame, column: str, labels: Sequence[str], primary: str) -> DataFrame:
    """Replace the listed labels by the primary one; nulls stay null."""
    merged = F.when(quoted(column).isin(list(labels)), F.lit(primary)).otherwise(quoted(column))
    return df.withColumn(column, merged)


def apply_label_map(df: DataFrame, label_map: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply many merges in one pass. ``label_map`` holds (column, label, primary).

    Labels are trimmed, so cells are compared without the blanks around them. A
    left join per mapped column. The stored map is broadcast while its count
    allows and goes through a skew-aware shuffle join beyond that.
    """
    unique = materialize(label_map.groupBy("column", "label").agg(F.min("primary").alias("primary")), "labels")
    result = df
    for c in columns:
        side = unique.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("primary").alias("_to"))
        result = (
            result.join(small_side(side), F.trim(quoted(c)) == F.col("_label"), "left")
            .withColumn(c, F.coalesce("_to", quoted(c)))
            .drop("_label", "_to")
        )
    return result.select(*[quoted(c) for c in df.columns])


# Name parts of identifiers and of measures.
ID_NAME_PARTS = ["_id", "id_", "uuid", "key", "code", "sku"]
MEASURE_NAME_PARTS = ["goal", "price", "amount", "charge", "score", "age", "tenure"]


def has_id_name(name: str) -> bool:
    low = name.lower()
    return low == "id" or any(part in low for part in ID_NAME_PARTS)


def id_like_columns(df: DataFrame) -> DataFrame:
    """Columns named like an identifier, or numeric with nearly unique values."""
    numbers = numeric_columns(df)
    n = df.count()
    need = max(20, int(0.9 * n))
    by_name = [c for c in df.columns if has_id_name(c)]
    unique = distinct_reaches(df, {c: need for c in numbers})
    rows = [(c, c in by_name, unique.get(c, False)) for c in df.columns if c in by_name or unique.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, by_name boolean, by_uniqueness boolean")


def quality_suggestions(df: DataFrame) -> DataFrame:
    """One row per finding: what to do, where, how much of it, and whether auto-clean does it."""
    facts = quality_facts(df)
    rows = F.expr("nullif(n_rows, 0)")
    per_column = facts.select(
        "column",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("n_missing") > 0,
                        F.struct(
                            F.when(F.col("kind") == "numeric", "impute_median").otherwise("impute_mode").alias("action"),
                            percent(F.col("n_missing"), rows).alias("amount"),
                            F.lit(True).alias("auto"),
                        ),
                    ),
                    F.when(
                        F.col("numbers_as_text"),
                        F.struct(F.lit("fix_dtype").alias("action"), F.lit(1.0).alias("amount"), F.lit(True).alias("auto")),
                    ),
                    F.when(
                        F.col("n_outliers") > 0,
                        F.struct(
                            F.lit("review_outliers").alias("action"),
                            F.col("n_outliers").cast("double").alias("amount"),
                            F.lit(False).alias("auto"),
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("s"),
    ).select("s.action", "column", "s.amount", "s.auto")
    duplicates = duplicate_count(df).where("n_duplicates > 0").select(
        F.lit("drop_duplicates").alias("action"),
        F.lit(None).cast("string").alias("column"),
        F.col("n_duplicates").cast("double").alias("amount"),
        F.lit(True).alias("auto"),
    )
    labels = (
        similar_label_groups(df)
        .groupBy("column")
        .agg(F.countDistinct("group_no").cast("double").alias("amount"))
        .select(F.lit("review_categories").alias("action"), "column", "amount", F.lit(False).alias("auto"))
    )
    return duplicates.unionByName(per_column).unionByName(labels)


def quality_decisions(df: DataFrame) -> DataFrame:
    """Choices left to the user: label groups to merge and numeric columns that may be identifiers, all of them in order."""
    groups = similar_label_groups(df)
    order = {c: i for i, c in enumerate(df.columns)}
    merges = groups.groupBy("column", "group_no").agg(
        F.sort_array(F.collect_list("label")).alias("labels"),  # the labels of one group
        F.max_by("label", F.struct("n", F.col("label"))).alias("primary"),
        F.sum("n").alias("n_rows"),
    )
    merges = merges.select(
        F.lit("category_merge").alias("type"), "column", "group_no", "labels", "primary", "n_rows"
    )
    ids = (
        id_like_columns(df)
        .where(F.col("column").isin([c for c in numeric_columns(df) if not _is_measure(c)]))
        .select(
            F.lit("id_or_feature").alias("type"),
            "column",
            F.lit(0).cast("bigint").alias("group_no"),
            F.lit(None).cast("array<string>").alias("labels"),
            F.lit(None).cast("string").alias("primary"),
            F.lit(None).cast("bigint").alias("n_rows"),
        )
    )
    place = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    both = merges.unionByName(ids).withColumn("_place", place[F.col("column")])
    return both.orderBy("type", "_place", "group_no").drop("_place")


def _is_measure(name: str) -> bool:
    return any(part in name.lower() for part in MEASURE_NAME_PARTS)


def decisions_to_label_map(decisions: DataFrame) -> DataFrame:
    """(column, label, primary) rows of confirmed merge decisions."""
    return (
        decisions.where(F.col("type") == "category_merge")
        .select("column", F.explode("labels").alias("label"), "primary")
        .where(F.col("label") != F.col("primary"))
    )


def label_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The "show counts" choice of a merge decision."""
    return value_frequencies(df, [column]).orderBy(F.desc("n"), "value").limit(top)


