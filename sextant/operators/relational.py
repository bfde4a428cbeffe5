"""Ranking, thresholding, shares, time series and filters over relational plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import as_double, is_numeric, quoted, rows_from_wide
from sextant.functions.dates import elapsed_days
from sextant.operators.joins import join_on_keys, small_side
from sextant.operators.ordering import ONE_TASK_ROWS, number_rows, with_previous
from sextant.scratch import materialize

RANKINGS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def top_n_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    metric: str,
    n: int,
    tie_break: Sequence[str] = (),
    ranking: str = "row_number",
    name: str = "rnk",
) -> DataFrame:
    """Best n rows of each group. The rank filter also runs before the exchange,
    so a hot group sends at most n rows (plus ties) per upstream task."""
    order = [F.desc(metric), *[F.asc(c) for c in tie_break]]
    window = W.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(name, RANKINGS[ranking]().over(window).cast("bigint")).where(F.col(name) <= n)


def qualifying_groups(df: DataFrame, group_cols: Sequence[str], condition: Column) -> DataFrame:
    """Keep rows of the groups whose aggregate meets the condition (a semi-join)."""
    good = df.groupBy(*group_cols).agg(condition.alias("_ok")).where("_ok").drop("_ok")
    return df.join(good, list(group_cols), "left_semi")


def group_aggregate(
    df: DataFrame, group: str, metric: str, agg: str = "mean", top: int = 15, name: str = "value"
) -> DataFrame:
    """Mean, sum or count of the numeric cells per group, largest first."""
    functions = {"mean": F.avg, "sum": F.sum, "count": F.count}
    value = as_double(df, metric)
    return (
        df.where(value.isNotNull() & quoted(group).isNotNull())
        .groupBy(quoted(group).alias(group))
        .agg(functions[agg](value).alias(name))
        .orderBy(F.desc(name), group)
        .limit(top)
    )


def time_series_mean(df: DataFrame, time: str, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per distinct timestamp; order it only when printing."""
    value = as_double(df, metric)
    return (
        df.where(quoted(time).isNotNull() & value.isNotNull())
        .groupBy(*keys, time)
        .agg(F.avg(value).alias(metric), F.count("*").alias("n_rows"))
    )


def share_of_total(df: DataFrame, group_cols: Sequence[str], metric: str, digits: int = 2) -> DataFrame:
    """Sum per group and its percentage of the overall sum.

    The total is a scalar subquery over the group sums, whose exchange both
    sides share, not a window over all groups in one task.
    """
    sums = df.groupBy(*group_cols).agg(F.sum(metric).alias("total"))
    overall = F.nullif(sums.agg(F.sum("total")).scalar(), F.lit(0.0))
    return sums.withColumn("pct_of_total", F.round(F.lit(100.0) * F.col("total") / overall, digits))


def global_top_n(df: DataFrame, metric: str, n: int, tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(metric), *tie_break).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def event_gaps(
    df: DataFrame, time: str, order_by: Sequence[str], keys: Sequence[str] = (), one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Days since the preceding row of the same key."""
    known = df.where(quoted(time).isNotNull())
    with_prev = with_previous(known, [time, *order_by], time, "previous_time", keys, one_task_rows)
    return with_prev.withColumn("gap_days", elapsed_days(quoted(time), F.col("previous_time")))


def event_index(
    df: DataFrame, time: str, order_by: Sequence[str], keys: Sequence[str] = (), one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Event number 1..n and days since the first event of the same key; a null key is a key of its own."""
    known = df.where(quoted(time).isNotNull())
    numbered = number_rows(known, [time, *order_by], keys, "event_no", one_task_rows)
    if keys:
        first = known.groupBy(*keys).agg(F.min(time).alias("_first"))
        numbered = join_on_keys(numbered, small_side(first), list(keys))
        return numbered.withColumn("elapsed_days", elapsed_days(quoted(time), F.col("_first"))).drop("_first")
    first_time = known.agg(F.min(time)).scalar()
    return numbered.withColumn("elapsed_days", elapsed_days(quoted(time), first_time))


def _filter_test(df: DataFrame, column: str, value) -> tuple[Column, Column | None]:
    """Exact test and, for text, the fallback used when nothing matches exactly."""
    if is_numeric(df, column):
        return as_double(df, column) == F.lit(float(value)), None
    cell, wanted = F.lower(quoted(column).cast("string")), str(value).lower()
    return cell == F.lit(wanted), F.contains(cell, F.lit(wanted))


def filter_predicates(df: DataFrame, filters: Sequence[tuple[str, object]]) -> list[Column]:
    """One predicate per filter, each settled on the rows its predecessors leave.

    Whether any row is equal is one early-stopping look per text filter. The
    result is plain predicates that reach the scan.
    """
    settled: list[Column] = []
    work = df
    for column, value in filters:
        exact, loose = _filter_test(df, column, value)
        chosen = exact if loose is None or not work.where(exact).isEmpty() else loose
        settled.append(chosen)
        work = work.where(chosen)
    return settled


def equal_or_contains(df: DataFrame, filters: Sequence[tuple[str, object]]) -> DataFrame:
    """Keep rows equal to each value in turn; text falls back to "contains" if no row is equal."""
    work = df
    for predicate in filter_predicates(df, filters):
        work = work.where(predicate)
    return work


def filter_notes(df: DataFrame, filters: Sequence[tuple[str, object]]) -> DataFrame:
    """(step, column, value, rows_before, rows_after) of :func:`equal_or_contains`, counted in one pass."""
    passed, aggs, records = F.lit(True), [F.count("*").alias("n0")], []
    for step, ((column, value), predicate) in enumerate(zip(filters, filter_predicates(df, filters)), start=1):
        passed = passed & F.coalesce(predicate, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n{step}"))
        records.append(
            [
                F.lit(step).cast("bigint").alias("step"),
                F.lit(column).alias("column"),
                F.lit(str(value)).alias("value"),
                F.col(f"n{step - 1}").alias("rows_before"),
                F.col(f"n{step}").alias("rows_after"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


def factorize(
    df: DataFrame, column: str, order_by: Sequence[str], name: str, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Dense codes 0, 1, ... in the order each value first appears; null gets -1.

    The codes come from the distinct values, so a hot value costs nothing extra.
    """
    first_seen = (
        df.where(quoted(column).isNotNull())
        .groupBy(quoted(column).alias("_value"))
        .agg(F.min(F.struct(*[quoted(c) for c in order_by])).alias("_first"))
    )
    flat = first_seen.select("_value", *[F.col("_first")[c].alias(f"_o{i}") for i, c in enumerate(order_by)])
    order = [f"_o{i}" for i in range(len(order_by))]
    codes = number_rows(flat, [*order, "_value"], (), "_code", one_task_rows).select("_value", "_code")
    codes = materialize(codes, "codes")
    return (
        df.join(small_side(codes), quoted(column) == F.col("_value"), "left")
        .withColumn(name, F.coalesce(F.col("_code") - 1, F.lit(-1)))
        .drop("_value", "_code")
    )


def value_intersect(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    a = left.select(quoted(left_column).cast("string").alias("value")).where("value is not null")
    b = right.select(quoted(right_column).cast("string").alias("value")).where("value is not null")
    return a.intersect(b)


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with the bands ``low <= value < high`` they fall in.

    Both sides are bucketed and joined on the bucket, so the range test only
    meets neighbours. A band up to ``width`` wide is at level 0; each level
    doubles the bucket, and a band takes the level that is as wide as it is, so
    it lies in two buckets at most however wide it is (four at the last level). A row goes to one bucket
    of every level in use; their number is bounded by the range of a double.
    Few bands are broadcast, so that a hot bucket moves no rows. Bands without a
    bound, or of no width, hold no row; an infinite bound is one like any other.
    """
    largest = 1.7e308
    top = math.floor(math.log2(largest) - math.log2(width))
    span = quoted(high).cast("double") - quoted(low).cast("double")
    level = F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.ceil(F.log2(F.least(span, F.lit(largest)) / F.lit(width))))).cast("int")
    levelled = bands.where(quoted(low) < quoted(high)).withColumn("_level", level)

    def bucket(c: Column, level: Column) -> Column:
        x = F.when(~F.isnan(c.cast("double")), F.greatest(F.lit(-largest), F.least(F.lit(largest), c.cast("double"))))
        place = x / (F.lit(width) * F.pow(F.lit(2.0), level))
        return F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), place)))

    ends = F.sequence(bucket(quoted(low), F.col("_level")), bucket(quoted(high), F.col("_level")))
    reach = levelled.withColumn("_bucket", F.explode(ends))
    levels = sorted(r["_level"] for r in levelled.select("_level").distinct().collect())
    placed = df.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    placed = placed.withColumn("_bucket", bucket(quoted(value), F.col("_level")))
    inside = (quoted(value) >= quoted(low)) & (quoted(value) < quoted(high))
    return placed.join(small_side(reach), ["_level", "_bucket"]).where(inside).drop("_level", "_bucket")
