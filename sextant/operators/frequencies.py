"""The frequency table (column, value, n) that several profiles are read from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sextant.columns import as_double, quoted

# Ratio by which a sketch estimate must exceed a limit before a proof is tried, and values the proof aims to count per limit.
SKETCH_SLACK = 4
PROOF_VALUES = 8
#: Buckets of hashes in which rows are counted to find frequent values.
BUCKETS = 4096


def value_text(df: DataFrame, name: str):
    """Cell as text so that columns of different types share one table."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return as_double(df, name).cast("string")
    return quoted(name).cast("string")


def value_frequencies(df: DataFrame, columns: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Distinct values of all columns with their counts: one scan, one shuffle of distinct pairs."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns]
    )
    long = df.select(F.inline(cells))
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of distinct non-null values per column."""
    columns = list(columns or df.columns)
    counts = distinct_counts(df, columns)
    return df.sparkSession.createDataFrame([(c, counts[c]) for c in columns], "column string, n_distinct bigint")


def cardinalities(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Schema-sized driver copy of :func:`cardinality`."""
    return distinct_counts(df, columns)


#: Types whose cells are told apart by their own 64 bits, without being written as text.
_PLAIN = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DateType, T.TimestampType)


def _cell(df: DataFrame, name: str):
    """Value by which equal cells are told: numbers and times as they are (zero has no sign), all others as text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return as_double(df, name) + F.lit(0.0)
    return quoted(name) if isinstance(kind, _PLAIN) else value_text(df, name)


def _prints(df: DataFrame, name: str) -> list:
    """128-bit fingerprint of a non-null cell, in two numbers."""
    return [F.xxhash64(F.lit(seed), _cell(df, name)) for seed in (1, 2)]


def _estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def proven_above(df: DataFrame, limits: dict[str, float], estimates: dict[str, int]) -> set[str]:
    """Columns with more distinct values than their limit, by counting some of them.

    Only values whose hash falls in a small share of all hashes are counted,
    some times the limit if the estimate is right. What is counted is there, so
    a wrong estimate can make the proof fail but never make it wrong.
    """
    tried = {c: max(1, int(estimates[c] / (max(limits[c], 1) * PROOF_VALUES))) for c in limits}
    if not tried:
        return set()
    cells = []
    for c, every in tried.items():
        mark, _ = _prints(df, c)
        chosen = _cell(df, c).isNotNull() & (F.pmod(mark, F.lit(every)) == 0)
        cells.append(F.struct(F.lit(c).alias("column"), F.when(chosen, mark).alias("mark")))
    seen = df.select(F.inline(F.array(*cells))).where("mark is not null").distinct()
    counts = {r["column"]: r["n"] for r in seen.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c for c in tried if counts.get(c, 0) > limits[c]}


def columns_within(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """Columns that are not proven to have more than ``limit`` distinct values.

    A sketch tells for which columns a proof is worth trying, so that free text
    stays out of the shuffle; callers count what is returned exactly.
    """
    if not columns:
        return []
    estimates = _estimates(df, columns)
    above = proven_above(df, {c: limit for c in columns if estimates[c] > limit * SKETCH_SLACK}, estimates)
    return [c for c in columns if c not in above]


def distinct_reaches(df: DataFrame, thresholds: dict[str, float]) -> dict[str, bool]:
    """Whether each column has at least so many distinct values.

    Columns far above are proven so from some of their values; all others are
    counted by fingerprints of 128 bits.
    """
    if not thresholds:
        return {}
    estimates = _estimates(df, list(thresholds))
    far = {c: t for c, t in thresholds.items() if estimates[c] > t * SKETCH_SLACK}
    above = proven_above(df, far, estimates)
    exact = distinct_counts(df, [c for c in thresholds if c not in above])
    return {c: c in above or exact[c] >= t for c, t in thresholds.items()}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values per column, told apart by fingerprints, so that no text is shuffled."""
    if not columns:
        return {}
    cells = []
    for k, c in enumerate(columns):
        marks = F.struct(*[m.alias(f"m{i}") for i, m in enumerate(_prints(df, c))])
        cells.append(F.struct(F.lit(k).alias("k"), F.when(_cell(df, c).isNotNull(), marks).alias("marks")))
    seen = df.select(F.inline(F.array(*cells))).where("marks is not null").select("k", "marks.m0", "marks.m1").distinct()
    counts = {r["k"]: r["n"] for r in seen.groupBy("k").agg(F.count("*").alias("n")).collect()}
    return {c: counts.get(k, 0) for k, c in enumerate(columns)}


def frequent_values(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """(column, value, n, total) of values, null included, that make up at least ``share`` of all rows.

    Rows are first counted in a fixed number of buckets of hashes: a value's
    bucket holds at least its own rows, so none is missed, and at most 1 / share
    buckets a column are full enough. Only values of these are then counted, of
    which there are few besides the frequent ones; free text is not shuffled.
    """
    names = dict(enumerate(columns))
    bucket = {i: F.pmod(F.xxhash64(value_text(df, c)), F.lit(BUCKETS)).cast("int") for i, c in names.items()}
    cells = [F.struct(F.lit(i).alias("i"), b.alias("bucket")) for i, b in bucket.items()]
    counted = df.select(F.inline(F.array(*cells))).groupBy("i", "bucket").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("i"))
    full = counted.withColumn("total", total).where(F.col("n") >= F.col("total") * share).collect()
    schema = "column string, value string, n bigint, total bigint"
    if not full:
        return df.sparkSession.createDataFrame([], schema)
    cells = []
    for i in sorted({r["i"] for r in full}):
        value = F.struct(F.lit(names[i]).alias("column"), value_text(df, names[i]).alias("value"))
        cells.append(F.when(bucket[i].isin([r["bucket"] for r in full if r["i"] == i]), value))
    found = df.select(F.explode(F.array(*cells)).alias("v")).where("v is not null").groupBy("v.column", "v.value")
    totals = df.sparkSession.createDataFrame(
        sorted({(names[r["i"]], r["total"]) for r in full}), "column string, total bigint"
    )
    each = found.agg(F.count("*").alias("n")).join(F.broadcast(totals), "column")
    return each.where(F.col("n") >= F.col("total") * share).select("column", "value", "n", "total")


def value_counts_topk(df: DataFrame, columns: Sequence[str], k: int = 15) -> DataFrame:
    """The k most frequent values of each column, ties by value.

    The rank filter is applied before the exchange too, so no task sees more
    than k rows per column and upstream partition.
    """
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_frequencies(df, columns)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )
