"""Exact quantiles that never gather a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so
it is used only below a checked row count. Beyond it an order statistic is
narrowed down: a sketch of a sample proposes a bracket, counts over all rows
prove or reject it, equal-width slices of the bracket are counted until the
slice holding the rank is small, and its values are ranked. The sample only
saves work; a bracket it got wrong is replaced by the whole extent of the
column. Each step is a column-pruned scan with a tiny shuffle, and repeated
values only add to a count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import as_double, quoted
from sextant.operators.joins import join_on_keys, small_side
from sextant.operators.ordering import running_count

# Rows the built-in percentile may buffer, and rows one task may sort.
BUFFER_ROWS = 100_000
ONE_TASK_ROWS = 2_000_000
SLICES = 4096
SKETCH_ACCURACY = 10_000
_LARGEST = "double('1.7976931348623157E308')"


@dataclass
class ColumnQuantiles:
    """Non-null count and the requested quantiles of one column (nulls when it is empty)."""

    n: int
    values: list[float | None]


@dataclass
class _Rank:
    """One order statistic being narrowed: ``rank`` counts from 0 within the column."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    narrows: bool = True

    @property
    def settled(self) -> bool:
        return self.low == self.high


def _number(value: float) -> str:
    return f"double('{value!r}')"


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    one_task_rows: int = ONE_TASK_ROWS,
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, ColumnQuantiles]:
    """Linear-interpolated quantiles of whole columns; the result is schema-sized."""
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    total = values.count()
    if total <= min(buffer_rows, one_task_rows):
        wanted = f"array({', '.join(_number(p) for p in probs)})"
        row = values.agg(
            *[F.expr(f"count({v}) as n_{v}") for v in values.columns],
            *[F.expr(f"percentile({v}, {wanted}) as {v}") for v in values.columns],
        ).first()
        return {
            c: ColumnQuantiles(row[f"n_{v}"], list(row[v]) if row[v] is not None else [None] * len(probs))
            for c, v in zip(columns, values.columns)
        }

    counts, ranks = _ranks(values, probs, _proposed_brackets(values, probs, total))
    targets = list(ranks.values())
    while wide := [t for t in targets if t.narrows and not t.settled and t.inside > one_task_rows]:
        _slice_brackets(values, wide)
    _settle(values, [t for t in targets if not t.settled])

    def interpolate(v: str, p: float) -> float | None:
        if not counts[v]:
            return None
        place = (counts[v] - 1) * p
        low, high = ranks[(v, math.floor(place))].low, ranks[(v, math.ceil(place))].low
        # The same weighing as Spark's percentile, so that both paths agree to the last digit.
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return {
        c: ColumnQuantiles(counts[v], [interpolate(v, p) for p in probs]) for c, v in zip(columns, values.columns)
    }


def _proposed_brackets(
    values: DataFrame, probs: Sequence[float], total: int
) -> dict[tuple[str, float], tuple[float, float] | None]:
    """Where each quantile should lie, five standard errors wide on either side."""
    size = max(100_000, total // 1000)
    margin = 2.5 / math.sqrt(min(size, total)) + 2.0 / SKETCH_ACCURACY
    edges = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)})
    wanted = f"array({', '.join(_number(e) for e in edges)})"
    sample = values.sample(min(1.0, size / total), seed=17) if size < total else values
    row = sample.agg(
        *[F.expr(f"percentile_approx({v}, {wanted}, {SKETCH_ACCURACY}) as {v}") for v in values.columns]
    ).first()
    brackets: dict[tuple[str, float], tuple[float, float] | None] = {}
    for v in values.columns:
        at = dict(zip(edges, row[v])) if row[v] is not None else None
        for p in probs:
            ends = (min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin)))
            brackets[(v, p)] = (at[ends[0]], at[ends[1]]) if at else None
    return brackets


def _ranks(
    values: DataFrame, probs: Sequence[float], brackets: dict[tuple[str, float], tuple[float, float] | None]
) -> tuple[dict[str, int], dict[tuple[str, int], _Rank]]:
    """Count all rows around the brackets; a rank outside its bracket starts from the whole extent."""
    place = {bracket: i for i, bracket in enumerate(dict.fromkeys((v, *b) for (v, _), b in brackets.items() if b))}
    aggs = [f"{name}({v}) as {name}_{v}" for v in values.columns for name in ("count", "min", "max")]
    for (v, low, high), i in place.items():
        low, high = _number(low), _number(high)
        aggs += [f"count_if({v} < {low}) as below{i}", f"count_if({v} >= {low} and {v} <= {high}) as inside{i}"]
    row = values.agg(*[F.expr(a) for a in aggs]).first()
    counts = {v: row[f"count_{v}"] for v in values.columns}
    ranks: dict[tuple[str, int], _Rank] = {}
    for (v, p), bracket in brackets.items():
        n = counts[v]
        if not n:
            continue
        for k in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
            if bracket:
                i = place[(v, *bracket)]
                below, inside = row[f"below{i}"], row[f"inside{i}"]
                if below <= k < below + inside:
                    ranks[(v, k)] = _Rank(v, k, *bracket, below, inside)
                    continue
            ranks.setdefault((v, k), _Rank(v, k, row[f"min_{v}"], row[f"max_{v}"], 0, n))
    return counts, ranks


def _rows_in_brackets(values: DataFrame, targets: list[_Rank]) -> DataFrame:
    """(c, v) of every cell that lies in a bracket of its column."""
    tests: dict[str, str] = {}
    for v in dict.fromkeys(t.column for t in targets):
        spans = {(t.low, t.high) for t in targets if t.column == v}
        tests[v] = " or ".join(f"({v} >= {_number(low)} and {v} <= {_number(high)})" for low, high in spans)
    cells = ", ".join(f"if({test}, struct('{v}' as c, {v} as v), null)" for v, test in tests.items())
    any_inside = " or ".join(f"({test})" for test in tests.values())
    return values.where(any_inside).selectExpr(f"inline(filter(array({cells}), x -> x is not null))")


def _with_targets(cells: DataFrame, targets: list[_Rank]) -> DataFrame:
    """Cells with the order statistics whose bracket they are in."""
    rows = [(t.column, i, t.low, t.high, t.rank - t.below) for i, t in enumerate(targets)]
    brackets = cells.sparkSession.createDataFrame(
        rows, "c string, target int, low double, high double, offset bigint"
    )
    # One row per order statistic: schema-sized, so the broadcast stays small at any data size.
    return cells.join(F.broadcast(brackets), "c").where("v >= low and v <= high")


def _slice_brackets(values: DataFrame, targets: list[_Rank]) -> None:
    """Replace each bracket by the one of its equal-width slices that holds the rank."""
    # Infinite ends are read as the largest finite values, and a width too small to divide by as one slice.
    v, low, high = (f"greatest(least({x}, {_LARGEST}), -{_LARGEST}) / 2" for x in ("v", "low", "high"))
    place = f"floor(coalesce(try_divide({v} - {low}, {high} - {low}), 0) * {SLICES})"
    sliced = (
        _with_targets(_rows_in_brackets(values, targets), targets)
        .withColumn("slice", F.expr(f"least({place}, {SLICES - 1})"))
        .groupBy("target", "offset", "slice")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    # At most SLICES rows per target reach this window.
    upto = F.sum("n").over(W.partitionBy("target").orderBy("slice"))
    holding = sliced.withColumn("upto", upto).where("offset < upto and offset >= upto - n")
    for row in holding.collect():  # one row per order statistic
        t = targets[row["target"]]
        t.narrows = (t.inside, t.low, t.high) != (row["n"], row["low"], row["high"])
        t.below += row["upto"] - row["n"]
        t.inside, t.low, t.high = row["n"], row["low"], row["high"]


def _settle(values: DataFrame, targets: list[_Rank]) -> None:
    """Rank the distinct values of the small final brackets."""
    if not targets:
        return
    distinct = _rows_in_brackets(values, targets).groupBy("c", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("target").orderBy("v"))
    found = _with_targets(distinct, targets).withColumn("upto", upto).where("offset < upto and offset >= upto - n")
    for row in found.select("target", "v").collect():  # one row per order statistic
        targets[row["target"]].low = targets[row["target"]].high = row["v"]


def grouped_medians(
    df: DataFrame, group_cols: Sequence[str], value: str, name: str, one_task_rows: int = BUFFER_ROWS
) -> DataFrame:
    """Exact median of ``value`` per group.

    Values are first reduced to distinct value and count. If every group then
    fits one task the built-in weighted percentile finishes the job; otherwise
    running counts over a range-partitioned layout locate the middle ranks, so
    one huge group is spread over many tasks.
    """
    keys = list(group_cols)
    freq = (
        df.where(quoted(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
    )
    largest = freq.groupBy(*keys).agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    if largest <= one_task_rows:
        return freq.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias(name))
    totals = freq.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    upto = running_count(freq, keys, [value], "_n", "_upto")
    joined = join_on_keys(upto, small_side(totals), keys)
    first, second = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_n"))
    return joined.groupBy(*keys).agg(
        # Halves as weights, as Spark's percentile has them.
        (
            0.5 * F.max(F.when(holds(first), quoted(value))) + 0.5 * F.max(F.when(holds(second), quoted(value)))
        ).alias(name)
    )
