"""Numbering, running counts and previous values over an order.

A plain window puts each group, or the whole table, in one task. These helpers
use it only for groups of a checked size. Above that the rows are range
partitioned on (group, order), written once so that the layout is fixed, and
each slice is numbered on its own with an offset from the slices before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import quoted
from sextant.scratch import materialize

ONE_TASK_ROWS = 2_000_000
_SLICE = "_slice"


def _largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _sliced(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], one_task_rows: int) -> DataFrame:
    """Range-partitioned rows with their slice number; enough slices for one task each."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(usual, math.ceil(df.count() / one_task_rows))
    laid = df.repartitionByRange(slices, *[quoted(c) for c in [*keys, *order_by]])
    return materialize(laid.withColumn(_SLICE, F.spark_partition_id()), "ordered")


def _before(keys: Sequence[str]):
    """Earlier slices of the same group; at most one row per slice and group."""
    return W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join slice summaries back; null group keys match each other."""
    left = rows.alias("r")
    right = summary.select(*[quoted(c).alias(f"_k_{c}") for c in [*keys, _SLICE]], "_carry")
    on = F.lit(True)
    for c in [*keys, _SLICE]:
        on = on & quoted(c).eqNullSafe(quoted(f"_k_{c}"))
    return left.join(right, on, "left").drop(*[f"_k_{c}" for c in [*keys, _SLICE]])


def running_count(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], weight: str, name: str,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Running sum of ``weight`` in order within each group, spread over many tasks."""
    rows = _sliced(df, keys, order_by, one_task_rows)
    summary = rows.groupBy(*keys, _SLICE).agg(F.sum(weight).alias("_sum"))
    summary = summary.withColumn("_carry", F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)))
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    joined = _attach(rows, summary, keys)
    return joined.withColumn(name, F.sum(weight).over(inside) + F.col("_carry")).drop("_carry", _SLICE)


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "row_no",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """1-based position of each row in its group. ``order_by`` must identify a row."""
    keys, order_by = list(keys), list(order_by)
    if _largest_group(df, keys) <= one_task_rows:
        window = W.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_count(one, keys, order_by, "_one", name, one_task_rows).drop("_one")


def with_previous(
    df: DataFrame,
    order_by: Sequence[str],
    value: str,
    name: str,
    keys: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add the value of the preceding row in order; null on the first row of a group."""
    keys, order_by = list(keys), list(order_by)
    if _largest_group(df, keys) <= one_task_rows:
        return df.withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(*order_by)))
    rows = _sliced(df, keys, order_by, one_task_rows)
    order_key: Column = F.struct(*[quoted(c) for c in order_by])
    summary = rows.groupBy(*keys, _SLICE).agg(F.max_by(quoted(value), order_key).alias("_last"))
    summary = summary.withColumn("_carry", F.last("_last").over(_before(keys)))
    window = W.partitionBy(*keys, _SLICE).orderBy(*order_by)
    joined = _attach(rows, summary, keys)
    first = F.row_number().over(window) == 1
    previous = F.when(first, F.col("_carry")).otherwise(F.lag(value).over(window))
    return joined.withColumn(name, previous).drop("_carry", _SLICE)
