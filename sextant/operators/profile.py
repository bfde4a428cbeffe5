"""Column profiles: missing values, duplicates, description, outliers, correlation, score.

Every profile of many columns is one wide aggregate turned into rows, never one
job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import (
    as_double,
    empty_like,
    numeric_columns,
    quoted,
    rows_from_wide,
    text_columns,
    without_nan,
)
from sextant.functions.numbers import to_integer, to_number
from sextant.operators.frequencies import columns_within, distinct_counts, frequent_values, value_counts_topk
from sextant.operators.joins import small_side
from sextant.operators.quantiles import ONE_TASK_ROWS, column_quantiles
from sextant.scratch import materialize


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / whole, 2)


# -- missing values ---------------------------------------------------------


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_missing, pct) for every column."""
    df = without_nan(df)
    wide = df.agg(
        F.count("*").alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    rows = rows_from_wide(
        wide,
        [
            [
                F.lit(c).alias("column"),
                F.col("n").alias("n_rows"),
                (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
            ]
            for i, c in enumerate(df.columns)
        ],
    )
    return rows.withColumn("pct", percent(F.col("n_missing"), F.expr("nullif(n_rows, 0)")))


def missing_profile(df: DataFrame) -> DataFrame:
    """Only the columns that have missing values."""
    return missing_counts(df).where("n_missing > 0").select("column", "n_missing", "pct")


def missing_heaviest(df: DataFrame, above_pct: float = 10.0) -> DataFrame:
    """The column with the largest missing share, if that exceeds the threshold."""
    share = F.lit(100.0) * F.col("n_missing") / F.col("n_rows")
    return (
        missing_counts(df)
        .where((F.col("n_rows") > 0) & (share > above_pct))
        .orderBy(F.desc("n_missing"), "column")
        .limit(1)
        .select("column", "n_missing", "pct")
    )


# -- duplicates -------------------------------------------------------------


def _repeated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose fingerprint comes more than once, and (n_rows, n_single) of the table.

    Only fingerprints of 128 bits are shuffled for all rows. Whole rows are
    compared among equal fingerprints alone, so a chance match changes nothing.
    """
    cells = F.struct(*[quoted(c) for c in df.columns])
    marks = [F.xxhash64(F.lit(seed), cells, *[quoted(c).isNull() for c in df.columns]).alias(f"_h{seed}") for seed in (1, 2)]
    prints = materialize(df.select(*marks).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")), "prints")
    sizes = prints.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("_n") == 1).alias("n_single"))
    twice = prints.where("_n > 1").select("_h1", "_h2")
    rows = df.select("*", *marks).join(small_side(twice), ["_h1", "_h2"], "left_semi").drop("_h1", "_h2")
    return rows, sizes


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Each row value that occurs more than once, with its number of copies.

    Copies collapse before the shuffle, so one value making up much of the table is no hot spot.
    """
    return _copies(_repeated(df)[0]).where("copies > 1")


def duplicate_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_duplicates): rows beyond the first copy; nulls compare equal."""
    rows, sizes = _repeated(df)
    distinct = _copies(rows).agg(F.count(F.lit(1))).scalar()
    return sizes.select("n_rows", (F.col("n_rows") - F.col("n_single") - distinct).alias("n_duplicates"))


# -- description ------------------------------------------------------------


def describe(df: DataFrame, columns: Sequence[str] | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Count, mean, median, std (0 for one value), min, max and quartiles per numeric column."""
    columns = list(columns or numeric_columns(df))
    quantiles = column_quantiles(df, columns, (0.25, 0.5, 0.75), one_task_rows)
    columns = [c for c in columns if quantiles[c].n]
    if not columns:
        return empty_like(
            df,
            "column string, count bigint, mean double, median double, std double, min double, max double, "
            "q25 double, q75 double",
        )
    aggs, records = [], []
    for i, c in enumerate(columns):
        v = as_double(df, c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
        ]
        q25, q50, q75 = quantiles[c].values
        records.append(
            [
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"m{i}").alias("mean"),
                F.lit(q50).alias("median"),
                F.col(f"s{i}").alias("std"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                F.lit(q25).alias("q25"),
                F.lit(q75).alias("q75"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


def median_mode(df: DataFrame) -> DataFrame:
    """Median of numeric columns and most frequent value of text columns ("Unknown" if empty)."""
    numbers, texts = numeric_columns(df), text_columns(df)
    medians = {c: q.values[0] for c, q in column_quantiles(df, numbers, (0.5,)).items()}
    rows = df.sparkSession.createDataFrame(
        [(c, medians[c], None) for c in numbers], "column string, median double, mode string"
    )
    if not texts:
        return rows
    top = value_counts_topk(df, texts, 1).select("column", "value")
    named = df.sparkSession.createDataFrame([(c,) for c in texts], "column string").join(top, "column", "left")
    return rows.unionByName(
        named.select(
            "column", F.lit(None).cast("double").alias("median"), F.coalesce("value", F.lit("Unknown")).alias("mode")
        )
    )


def variance_rank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns by sample variance, largest first (0 with fewer than two values)."""
    columns = list(columns or numeric_columns(df))
    wide = df.agg(*[F.var_samp(as_double(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = rows_from_wide(
        wide,
        [
            [F.lit(c).alias("column"), F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("variance")]
            for i, c in enumerate(columns)
        ],
    )
    # One row per column, so a single-partition rank is schema-sized.
    return rows.withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("variance"), "column")).cast("bigint")
    )


def low_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns too flat to model: under 2 values, zero spread, or <= 3 values with CV below 1 %."""
    columns = list(columns or numeric_columns(df))
    few = columns_within(df, columns, 3)
    aggs, records = [], []
    for i, c in enumerate(columns):
        v = as_double(df, c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s{i}"),
            F.avg(F.abs(v)).alias(f"a{i}"),
        ]
        # Only columns not proven to have more values pay for a set, which then holds a handful of values.
        if c in few:
            aggs.append(F.size(F.collect_set(v)).alias(f"d{i}"))
        distinct = F.col(f"d{i}") if c in few else F.lit(4)
        reason = (
            F.when(F.col(f"n{i}") < 2, "too_few")
            .when((distinct <= 1) | (F.col(f"s{i}") == 0), "constant")
            .when((distinct <= 3) & (F.col(f"a{i}") > 0) & (F.col(f"s{i}") < F.col(f"a{i}") * 0.01), "nearly_constant")
        )
        records.append(
            [
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("n"),
                F.col(f"s{i}").alias("std"),
                F.col(f"a{i}").alias("mean_abs"),
                reason.isNotNull().alias("low_variance"),
                reason.alias("reason"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


# -- outliers ---------------------------------------------------------------


def fences(
    df: DataFrame, columns: Sequence[str], k: float, min_values: int, one_task_rows: int = ONE_TASK_ROWS
) -> dict[str, tuple[float, float, int]]:
    """(low, high, non-null count) per column with enough values and a positive IQR."""
    result = {}
    for c, q in column_quantiles(df, columns, (0.25, 0.75), one_task_rows).items():
        if q.n >= min_values and q.values[1] > q.values[0]:
            spread = q.values[1] - q.values[0]
            result[c] = (q.values[0] - k * spread, q.values[1] + k * spread, q.n)
    return result


OUTLIER_SCHEMA = "column string, n_outliers bigint, pct double, low double, high double"


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, min_values: int = 4,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Values strictly outside the quartile fences; percentage of all rows."""
    columns = list(columns or numeric_columns(df))
    bounds = fences(df, columns, k, min_values, one_task_rows)
    if not bounds:
        return empty_like(df, OUTLIER_SCHEMA)
    aggs, records = [F.count("*").alias("n")], []
    for i, (c, (low, high, _)) in enumerate(bounds.items()):
        v = as_double(df, c)
        aggs.append(F.count_if((v < F.lit(low)) | (v > F.lit(high))).alias(f"o{i}"))
        records.append(
            [
                F.lit(c).alias("column"),
                F.col(f"o{i}").alias("n_outliers"),
                percent(F.col(f"o{i}"), F.col("n")).alias("pct"),
                F.lit(low).alias("low"),
                F.lit(high).alias("high"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records).where("n_outliers > 0")


def outlier_rows(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, min_values: int = 4) -> DataFrame:
    """The rows behind the outlier counts, each with the names of its columns outside the fences."""
    columns = list(columns or numeric_columns(df))
    tests = []
    for c, (low, high, _) in fences(df, columns, k, min_values).items():
        v = as_double(df, c)
        tests.append(F.when((v < F.lit(low)) | (v > F.lit(high)), F.lit(c)))
    names = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return df.withColumn("outlier_columns", names).where(F.size("outlier_columns") > 0)


def outlier_examples(df: DataFrame, columns: Sequence[str] | None = None, examples: int = 5) -> DataFrame:
    """Outlier counts with the most extreme distinct values as examples, one row per example."""
    columns = list(columns or numeric_columns(df))
    bounds = fences(df, columns, 1.5, 4)
    if not bounds:
        return empty_like(df, OUTLIER_SCHEMA + ", example_rank bigint, example double")
    cells = []
    for c, (low, high, _) in bounds.items():
        v = as_double(df, c)
        cells.append(
            F.when(
                (v < F.lit(low)) | (v > F.lit(high)),
                F.struct(
                    F.lit(c).alias("column"), F.lit(low).alias("low"), F.lit(high).alias("high"), v.alias("example")
                ),
            )
        )
    flagged = df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    beyond = F.greatest(F.col("low") - F.col("example"), F.col("example") - F.col("high"))
    distinct = flagged.groupBy("column", "low", "high", "example").agg(F.count("*").alias("n"))
    counted = distinct.groupBy("column").agg(F.sum("n").alias("n_outliers"))
    ranked = distinct.withColumn(
        "example_rank",
        F.row_number().over(W.partitionBy("column").orderBy(F.desc(beyond), "example")).cast("bigint"),
    ).where(F.col("example_rank") <= examples)
    total = df.agg(F.count("*")).scalar()
    return ranked.join(counted, "column").select(
        "column", "n_outliers", percent(F.col("n_outliers"), total).alias("pct"), "low", "high",
        "example_rank", "example",
    )


def spike_dip(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Few values beyond 2.5 IQR: ``spike`` above, ``dip`` below; many such values are no anomaly."""
    columns = list(columns or numeric_columns(df))
    bounds = fences(df, columns, 2.5, 8)
    schema = "column string, kind string, n_flagged bigint, fence double"
    if not bounds:
        return empty_like(df, schema)
    aggs, records = [], []
    for i, (c, (low, high, n)) in enumerate(bounds.items()):
        v = as_double(df, c)
        limit = F.lit(max(3.0, 0.05 * n))
        for kind, fence, test in (("spike", high, v > F.lit(high)), ("dip", low, v < F.lit(low))):
            aggs.append(F.count_if(test).alias(f"{kind}{i}"))
            seen = F.col(f"{kind}{i}")
            records.append(
                [
                    F.lit(c).alias("column"),
                    F.lit(kind).alias("kind"),
                    F.when(seen <= limit, seen).otherwise(F.lit(0)).alias("n_flagged"),
                    F.lit(fence).alias("fence"),
                ]
            )
    return rows_from_wide(df.agg(*aggs), records).where("n_flagged > 0")


def imbalance(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.85) -> DataFrame:
    """Categorical columns dominated by one value; null counts as a value of its own."""
    columns = list(columns or text_columns(df))
    if not columns:
        return empty_like(df, "column string, top_value string, top_share double, n_values bigint")
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")  # at most 1 / share values a column
    top = frequent_values(df, columns, share).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    top = materialize(top.drop("_r"), "frequent")
    dominated = [r["column"] for r in top.select("column").collect()]
    values = distinct_counts(df, dominated)
    nulls = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(dominated)]).first() if dominated else []
    known = [(c, values[c] + (1 if nulls[f"n{i}"] else 0)) for i, c in enumerate(dominated)]
    sizes = df.sparkSession.createDataFrame(known, "column string, n_values bigint").where("n_values >= 2")
    return top.join(F.broadcast(sizes), "column").select(
        "column",
        F.coalesce("value", F.lit("__null__")).alias("top_value"),
        (F.col("n") / F.col("total")).alias("top_share"),
        "n_values",
    )


# -- distribution -----------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins are reported with 0. Infinite values have no bin."""
    cell = as_double(df, column)
    v = F.when(F.abs(cell) < F.lit(float("inf")), cell)
    extent = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("e")).scalar()
    low, high = extent["low"], extent["high"]
    width = F.nullif((high - low) / bins, F.lit(0.0))
    bin_no = F.least(F.coalesce(F.floor((v - low) / width), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    counted = df.where(v.isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    step = (high - low) / bins
    return every.join(counted, "bin", "left").select(
        "bin",
        (low + F.col("bin") * step).alias("lower"),
        (low + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


# -- correlation ------------------------------------------------------------


def pairwise_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, r): Pearson's r of each pair over its complete rows, in pair order.

    Columns are centred on means from a first pass, so plain sums are stable.
    Columns without gaps share their own sums; only a pair with gaps pays for
    sums over its common rows. A constant side gives null, not a division error.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    pre = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        v = as_double(df, c)
        pre += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), (F.min(v) < F.max(v)).alias(f"varies{i}")]
    row = df.agg(*pre).first()
    place = {c: i for i, c in enumerate(columns)}
    varies = {c: bool(row[f"varies{i}"]) for c, i in place.items()}
    full = {c: row[f"n{i}"] == row["n"] for c, i in place.items()}
    centred = df.select(*[(as_double(df, c) - F.lit(row[f"m{i}"] or 0.0)).alias(f"x{i}") for c, i in place.items()])

    # SQL text instead of column objects: with p columns there are p² / 2 of these.
    sums: dict[str, str] = {"_n": "count(*)"}
    records = []
    for a, b in pairs:
        i, j = place[a], place[b]
        if not (varies[a] and varies[b]):
            n, vx, vy, cxy = str(min(row[f"n{i}"], row[f"n{j}"])), "null", "null", "null"
        elif full[a] and full[b]:
            n, sx, sy, xx, yy, xy = "_n", f"s{i}", f"s{j}", f"q{i}", f"q{j}", f"p{i}_{j}"
            for k in (i, j):
                sums[f"s{k}"], sums[f"q{k}"] = f"sum(x{k})", f"sum(x{k} * x{k})"
            sums[xy] = f"sum(x{i} * x{j})"
            vx, vy, cxy = f"{xx} - {sx} * {sx} / nullif({n}, 0)", f"{yy} - {sy} * {sy} / nullif({n}, 0)", f"{xy} - {sx} * {sy} / nullif({n}, 0)"
        else:
            key, both = f"{i}_{j}", f"filter (where x{i} is not null and x{j} is not null)"
            n = f"n{key}"
            parts = {"n": "count(*)", "p": f"sum(x{i} * x{j})"}
            for side, k in (("x", i), ("y", j)):
                parts |= {
                    f"s{side}": f"sum(x{k})", f"q{side}": f"sum(x{k} * x{k})", f"lo{side}": f"min(x{k})", f"hi{side}": f"max(x{k})"
                }
            sums |= {f"{name}{key}": f"{text} {both}" for name, text in parts.items()}
            v = {s: f"if(lo{s}{key} < hi{s}{key}, q{s}{key} - s{s}{key} * s{s}{key} / nullif({n}, 0), null)" for s in "xy"}
            vx, vy, cxy = v["x"], v["y"], f"p{key} - sx{key} * sy{key} / nullif({n}, 0)"
        a_text, b_text = (c.replace("\\", "\\\\").replace("'", "\\'") for c in (a, b))
        records.append(
            f"struct('{a_text}' as col_a, '{b_text}' as col_b, cast({n} as bigint) as n, "
            f"cast({vx} as double) as vx, cast({vy} as double) as vy, cast({cxy} as double) as cxy)"
        )
    wide = centred.agg(*[F.expr(f"{text} as {name}") for name, text in sums.items()])
    moments = wide.selectExpr(f"inline(array({', '.join(records)}))")
    spread = F.sqrt(F.greatest(F.col("vx") * F.col("vy"), F.lit(0.0)))
    return moments.select("col_a", "col_b", "n", F.try_divide("cxy", spread).alias("r"))


def upper_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) for each pair of different columns, in column order."""
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return empty_like(df, "col_a string, col_b string, r double")
    return pairwise_correlation(df, pairs).drop("n")


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Full Pearson matrix in long form; r is null where a column is constant."""
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = pairwise_correlation(df, pairs).withColumn("r", F.round("r", digits))
    ways = F.when(F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b"))).otherwise(
        F.array(F.struct("col_a", "col_b"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b")))
    )
    return upper.select(F.explode(ways).alias("p"), "r").select("p.col_a", "p.col_b", "r")


def corr_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, min_abs: float = 0.45, top: int = 5
) -> DataFrame:
    """Strongest pairs by absolute correlation."""
    return (
        upper_correlations(df, columns)
        .where(F.abs("r") >= min_abs)
        .orderBy(F.desc(F.abs("r")), "col_a", "col_b")
        .limit(top)
    )


# -- types ------------------------------------------------------------------


def numbers_as_text(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Text columns of which at least 80 % of the non-null cells are numbers once commas are dropped."""
    texts = text_columns(df)
    if not texts:
        return empty_like(df, "column string, n_values bigint, n_numeric bigint, share double")
    aggs, records = [], []
    for i, c in enumerate(texts):
        aggs += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.count(to_number(quoted(c), thousands=True)).alias(f"k{i}"),
        ]
        records.append(
            [
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("n_values"),
                F.col(f"k{i}").alias("n_numeric"),
                F.try_divide(F.col(f"k{i}"), F.col(f"n{i}")).alias("share"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records).where(F.col("share") >= share)


def infer_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Target type of every text column: numeric, else timestamp, if 80 % of all rows parse."""
    from sextant.functions.dates import parse_mixed_date, strip_null_tokens

    texts = text_columns(df)
    schema = "column string, n_rows bigint, n_numeric bigint, n_datetime bigint, inferred string"
    if not texts:
        return empty_like(df, schema)
    aggs, records = [F.count("*").alias("n")], []
    for i, c in enumerate(texts):
        filled = F.count(strip_null_tokens(quoted(c)))
        aggs += [
            F.count(to_number(quoted(c))).alias(f"num{i}"),
            (F.count(to_integer(quoted(c))) == filled).alias(f"int{i}"),
            F.count(parse_mixed_date(quoted(c))).alias(f"dt{i}"),
        ]
        need = F.col("n") * share
        number = (F.col(f"num{i}") >= need) & (F.col("n") > 0)
        records.append(
            [
                F.lit(c).alias("column"),
                F.col("n").alias("n_rows"),
                F.col(f"num{i}").alias("n_numeric"),
                F.col(f"dt{i}").alias("n_datetime"),
                F.when(number & F.col(f"int{i}"), "bigint")
                .when(number, "double")
                .when((F.col(f"dt{i}") >= need) & (F.col("n") > 0), "timestamp")
                .otherwise("string")
                .alias("inferred"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


def apply_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Cast text columns to the types :func:`infer_types` finds; cells that do not parse become null."""
    from sextant.functions.dates import parse_mixed_date

    found = {r["column"]: r["inferred"] for r in infer_types(df, share).collect()}  # one row per column
    casts = {"bigint": to_integer, "double": to_number, "timestamp": parse_mixed_date}
    return df.select(
        *[
            casts[found[c]](quoted(c)).alias(c) if found.get(c, "string") != "string" else quoted(c)
            for c in df.columns
        ]
    )


# -- score ------------------------------------------------------------------


def quality_facts(df: DataFrame) -> DataFrame:
    """(column, kind, n_rows, n_missing, numbers_as_text, n_outliers): all columns in one aggregate.

    Besides the quantile scans behind the fences this is a single pass.
    """
    df = without_nan(df)
    numbers, texts = numeric_columns(df), text_columns(df)
    bounds = fences(df, numbers, 1.5, 4)
    aggs, records = [F.count("*").alias("n")], []
    for i, c in enumerate(df.columns):
        v = quoted(c)
        aggs.append(F.count(v).alias(f"c{i}"))
        as_text, outliers = F.lit(False), F.lit(0).cast("bigint")
        if c in texts:
            aggs.append(F.count(to_number(v, thousands=True)).alias(f"k{i}"))
            as_text = (F.col(f"c{i}") > 0) & (F.col(f"k{i}") >= F.col(f"c{i}") * 0.8)
        if c in bounds:
            low, high, _ = bounds[c]
            number = as_double(df, c)
            aggs.append(F.count_if((number < F.lit(low)) | (number > F.lit(high))).alias(f"o{i}"))
            outliers = F.col(f"o{i}")
        records.append(
            [
                F.lit(c).alias("column"),
                F.lit("numeric" if c in numbers else "text" if c in texts else "other").alias("kind"),
                F.col("n").alias("n_rows"),
                (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
                as_text.alias("numbers_as_text"),
                outliers.alias("n_outliers"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


def quality_score(df: DataFrame) -> DataFrame:
    """One row: the four penalties and the score from 0 to 100."""
    df = without_nan(df)
    rows = F.expr("nullif(n_rows, 0)")
    facts = (
        quality_facts(df)
        .agg(
            F.struct(
                F.sum(F.coalesce(percent(F.col("n_missing"), rows), F.lit(0.0))).alias("missing"),
                F.count_if("numbers_as_text").alias("issues"),
                F.avg(F.when(F.col("n_outliers") > 0, percent(F.col("n_outliers"), rows))).alias("outliers"),
            ).alias("f")
        )
        .scalar()
    )
    duplicates = F.try_divide(100.0 * F.col("n_duplicates"), F.col("n_rows"))
    base = duplicate_count(df).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.least(F.lit(30.0), facts["missing"] / len(df.columns)).alias("missing_penalty"),
        F.least(F.lit(20.0), F.coalesce(duplicates, F.lit(0.0))).alias("duplicate_penalty"),
        F.least(F.lit(15.0), F.lit(5.0) * facts["issues"]).alias("type_penalty"),
        F.least(F.lit(15.0), F.coalesce(facts["outliers"], F.lit(0.0)) * 0.3).alias("outlier_penalty"),
    )
    score = F.lit(100.0)
    for part in ("missing", "duplicate", "type", "outlier"):
        score = score - F.col(f"{part}_penalty")
    return base.withColumn("score", F.greatest(F.lit(0.0), F.round(score, 1)))
