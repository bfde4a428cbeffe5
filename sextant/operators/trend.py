"""Linear trends with residual bands, for one series or for every group in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.columns import as_double, quoted, rows_from_wide, time_columns
from sextant.functions.dates import add_days, elapsed_days, parse_mixed_date, strip_null_tokens
from sextant.operators.joins import join_on_keys, small_side
from sextant.operators.ordering import ONE_TASK_ROWS, number_rows, with_previous
from sextant.operators.profile import low_variance
from sextant.operators.quantiles import grouped_medians
from sextant.operators.roles import default_metric
from sextant.scratch import materialize

BAND_Z = 1.96
BAND_GROWTH = 0.1
IRREGULAR_CV = 0.35
IRREGULAR_RATIO = 3.0

_ALL = "_all"


def date_parse_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How well each column reads as dates: one row per column, one aggregate for all."""

    times = time_columns(df)
    aggs, records = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        if c in times:
            filled = parsed = F.count(quoted(c))
        else:
            text = quoted(c).cast("string")
            filled, parsed = F.count(strip_null_tokens(text)), F.count(parse_mixed_date(text))
        aggs += [filled.alias(f"f{i}"), parsed.alias(f"p{i}")]
        failed = F.col(f"f{i}") - F.col(f"p{i}")
        rate = F.coalesce(F.try_divide(failed, F.col(f"f{i}")), F.lit(1.0))
        records.append(
            [
                F.lit(c).alias("column"),
                F.col("n").alias("n_total"),
                F.col(f"f{i}").alias("n_non_null"),
                F.col(f"p{i}").alias("n_parsed"),
                failed.alias("n_failed"),
                rate.alias("fail_rate"),
                ((F.col(f"p{i}") >= 3) & (rate <= 0.5)).alias("parse_ok"),
                (rate > 0.05).alias("warning"),
            ]
        )
    return rows_from_wide(df.agg(*aggs), records)


class Series:
    """Series to be fitted: keys, position ``t`` in days, value ``y`` and gap to the previous point.

    The mean-per-timestamp table is written once, since the gap, fit and
    residual steps all read it; it is far smaller than the input rows.
    """

    def __init__(self, points: DataFrame, keys: list[str], dated: bool, every: DataFrame):
        self.points = points
        self.every = every  # keys of all series, also of those without a usable point
        self.keys = keys
        self.dated = dated

    @classmethod
    def by_time(
        cls, df: DataFrame, time: str, metric: str, keys: Sequence[str] = (), one_task_rows: int = ONE_TASK_ROWS
    ) -> Series:
        keys = list(keys)
        stamp = quoted(time)
        if time not in time_columns(df):
            stamp = parse_mixed_date(quoted(time).cast("string"))
        rows = df.select(*[quoted(k) for k in keys], stamp.alias("ts"), as_double(df, metric).alias("y"))
        rows, keys = cls._keyed(rows, keys)
        # Cells without a time or value stay in the stored table as one row per series and kind, so that no series is lost.
        stored = materialize(
            rows.groupBy(*keys, "ts").agg(F.avg("y").alias("y")), "series"
        )
        means = stored.where("ts is not null and y is not null")
        chained = with_previous(means, ["ts"], "ts", "_previous", keys, one_task_rows)
        first = means.groupBy(*keys).agg(F.min("ts").alias("_first"))
        points = join_on_keys(chained, small_side(first), keys).select(
            *keys,
            "ts",
            "y",
            elapsed_days(F.col("ts"), F.col("_first")).alias("t"),
            elapsed_days(F.col("ts"), F.col("_previous")).alias("gap_days"),
        )
        return cls(points, keys, True, stored.select(*keys).distinct())

    @classmethod
    def by_order(
        cls, df: DataFrame, order_by: Sequence[str], metric: str, keys: Sequence[str] = (),
        one_task_rows: int = ONE_TASK_ROWS,
    ) -> Series:
        """Series without usable dates: the position is the event number."""
        keys = list(keys)
        y = as_double(df, metric)
        rows = df.select(
            *[quoted(k) for k in keys], *[quoted(c).alias(f"_o{i}") for i, c in enumerate(order_by)], y.alias("y")
        )
        rows, keys = cls._keyed(rows, keys)
        order = [f"_o{i}" for i in range(len(order_by))]
        known = rows.where("y is not null")
        numbered = materialize(number_rows(known, order, keys, "_no", one_task_rows), "series")
        points = numbered.select(
            *keys,
            F.lit(None).cast("timestamp").alias("ts"),
            "y",
            (F.col("_no") - 1).cast("double").alias("t"),
            F.when(F.col("_no") > 1, F.lit(1.0)).alias("gap_days"),
        )
        return cls(points, keys, False, rows.select(*keys).distinct())

    @classmethod
    def by_clock(
        cls, df: DataFrame, time: str, metric: str, keys: Sequence[str], order_by: Sequence[str],
        one_task_rows: int = ONE_TASK_ROWS,
    ) -> Series:
        """Each series by the clock it has: dates where three or more and at least half of its cells read as dates, else events."""
        keys = list(keys)
        text = quoted(time).cast("string")
        stamp, filled = parse_mixed_date(text), strip_null_tokens(text)
        if time in time_columns(df):
            stamp = filled = quoted(time)
        order = [quoted(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
        rows = df.select(*[quoted(k) for k in keys], *order, stamp.alias("_ts"), filled.alias("_cell"), as_double(df, metric).alias("_y"))
        rows, keys = cls._keyed(rows, keys)
        parsed, cells = F.count("_ts"), F.count("_cell")
        clocks = rows.groupBy(*keys).agg(((parsed >= 3) & (parsed * 2 >= cells)).alias("_dated"))
        clocks = materialize(clocks, "clocks")
        told = join_on_keys(rows, small_side(clocks), keys).withColumnRenamed("_y", "y").drop("_cell")
        dated = cls.by_time(told.where("_dated"), "_ts", "y", keys, one_task_rows)
        counted = cls.by_order(told.where("not _dated"), [f"_o{i}" for i in range(len(order_by))], "y", keys, one_task_rows)
        return cls(dated.points.unionByName(counted.points), keys, True, clocks.select(*keys))

    @staticmethod
    def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
        """Give an ungrouped series a constant key; rows without a key are a series of their own."""
        if not keys:
            return rows.withColumn(_ALL, F.lit(1)), [_ALL]
        return rows, keys

    def plain(self, df: DataFrame) -> DataFrame:
        return df.drop(_ALL)


def spacing(series: Series) -> DataFrame:
    """Gap statistics per series and whether the spacing is irregular."""
    stats = series.points.groupBy(*series.keys).agg(
        F.count("gap_days").alias("n_gaps"),
        F.avg("gap_days").alias("mean_gap"),
        F.stddev_pop("gap_days").alias("std_gap"),
        F.max("gap_days").alias("max_gap"),
    )
    medians = grouped_medians(series.points, series.keys, "gap_days", "median_gap")
    both = join_on_keys(stats, medians, series.keys, "left")
    irregular = (F.col("n_gaps") >= 2) & (
        (F.col("mean_gap") <= 0)
        | F.coalesce(F.try_divide(F.col("max_gap"), F.col("median_gap")) >= IRREGULAR_RATIO, F.lit(False))
        | F.coalesce(F.try_divide(F.col("std_gap"), F.col("mean_gap")) >= IRREGULAR_CV, F.lit(False))
    )
    step = F.when(F.col("median_gap") > 0, F.col("median_gap")).otherwise(F.lit(1.0))
    return both.withColumn("irregular", irregular).withColumn("step_days", step)


def trend_fit(series: Series) -> DataFrame:
    """Least-squares line, R² and residual spread per series, with a status instead of an exception.

    The spread comes from a second aggregate over the residuals: the closed
    form from the moments loses all digits when the fit is nearly perfect.
    """
    keys = series.keys
    fit = series.points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("ts").alias("last_ts"),
        F.max("t").alias("last_t"),
        F.avg("t").alias("_mt"),
        F.avg("y").alias("_my"),
        F.regr_sxx("y", "t").alias("_sxx"),
        F.regr_sxy("y", "t").alias("_sxy"),
        F.stddev_pop("y").alias("_sdy"),
        F.min("y").alias("_miny"),
        F.max("y").alias("_maxy"),
        F.stddev_samp("y").alias("_sd"),
        F.avg(F.abs("y")).alias("_absy"),
    )
    slope = F.coalesce(F.try_divide(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    fit = fit.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mt"))
    # At most one value strictly between the extremes means at most three distinct values.
    between = (F.col("y") > F.col("_miny")) & (F.col("y") < F.col("_maxy"))
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("t")
    squares = (
        join_on_keys(series.points, small_side(fit.select(*keys, "slope", "intercept", "_my", "_miny", "_maxy")), keys)
        .groupBy(*keys)
        .agg(
            F.sum(residual * residual).alias("_sse"),
            F.sum(F.pow(F.col("y") - F.col("_my"), F.lit(2.0))).alias("_sst"),
            F.min(F.when(between, F.col("y"))).alias("_lowmid"),
            F.max(F.when(between, F.col("y"))).alias("_highmid"),
        )
    )
    scale = F.sqrt(F.col("_sse") / F.when(F.col("n") > 2, F.col("n") - 2).otherwise(F.col("n")))
    floor = F.greatest(F.abs("_my") * 0.05, F.lit(1e-6))
    few_values = F.coalesce(F.col("_lowmid") == F.col("_highmid"), F.lit(True))
    status = (
        F.when(F.col("n") < 3, "too_few")
        .when(F.col("_sdy") < 1e-9, "constant")
        .when(few_values & (F.col("_sd") < F.col("_absy") * 0.01), "nearly_constant")
        .otherwise("ok")
    )
    fitted = join_on_keys(
        join_on_keys(fit, squares, keys), spacing(series).select(*keys, "irregular", "step_days"), keys
    ).select(
        *keys,
        "n",
        "last_ts",
        "last_t",
        "slope",
        "intercept",
        (1 - F.try_divide("_sse", "_sst")).alias("r2"),
        F.when(scale > 0, scale).otherwise(floor).alias("resid_std"),
        "step_days",
        "irregular",
        (F.col("_miny") >= -1e-12).alias("nonnegative"),
        status.alias("status"),
    )
    return join_on_keys(series.every, fitted, keys, "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "status": F.coalesce("status", F.lit("too_few"))}
    )


def trend_forecast(fit: DataFrame, keys: Sequence[str], horizon: int | Column, dated: bool = True) -> DataFrame:
    """Point and band for the next steps of each series whose status is ``ok``.

    A regular series with dates gets dates, any other "Event +h". Bands widen with
    the step and are clipped at 0 if the history never is negative.
    """
    steps = horizon if isinstance(horizon, Column) else F.lit(horizon)
    steps = F.greatest(steps.cast("int"), F.lit(1))
    ahead = fit.where("status = 'ok'").withColumn("h", F.explode(F.sequence(F.lit(1), steps)))
    at = F.col("last_t") + F.col("step_days") * F.col("h")
    point = F.col("intercept") + F.col("slope") * at
    half = F.lit(BAND_Z) * F.col("resid_std") * (1 + F.lit(BAND_GROWTH) * F.col("h"))

    def clip(value: Column) -> Column:
        return F.when(F.col("nonnegative"), F.greatest(value, F.lit(0.0))).otherwise(value)

    event = F.concat(F.lit("Event +"), F.col("h").cast("string"))
    label = event
    if dated:
        day = F.date_format(add_days(F.col("last_ts"), F.col("step_days") * F.col("h")), "yyyy-MM-dd")
        label = F.when(F.col("irregular") | F.col("last_ts").isNull(), event).otherwise(day)
    return ahead.select(
        *keys,
        F.col("h").cast("bigint").alias("h"),
        label.alias("period"),
        clip(point).alias("forecast"),
        clip(point - half).alias("lower_95"),
        clip(point + half).alias("upper_95"),
    )


def settled_metric(df: DataFrame, metric: str, exclude: Sequence[str] = ()) -> str:
    """The metric, or if it hardly varies the default one of the other columns, where there is one that varies."""
    if not _flat(df, metric):
        return metric
    other = default_metric(df, [metric, *exclude])
    return metric if other is None or _flat(df, other) else other


def _flat(df: DataFrame, metric: str) -> bool:
    y = as_double(df, metric)
    n, spread, size = df.agg(F.count(y), F.stddev_samp(y), F.avg(F.abs(y))).first()
    if n > 1 and spread and spread >= 0.01 * size:  # varies too much for any reason to call it flat
        return False
    return low_variance(df, [metric]).first()["low_variance"]


def forecast_by_time(
    df: DataFrame, time: str, metric: str, keys: Sequence[str] = (), horizon: int | None = None, period: str = "",
    order_by: Sequence[str] = (), switch: bool = True,
) -> DataFrame:
    """Fit and extrapolate in one call; the horizon follows from the period word if not given.

    A series whose times do not read as dates goes by the order of its events in
    ``order_by``, whatever the other series do; where that is not named and no
    series has dates, an error says so. A metric that hardly varies is changed
    for the default one, see ``settled_metric``, unless ``switch`` is false.
    """
    if switch:
        metric = settled_metric(df, metric, [time, *keys, *order_by])
    if order_by:
        series = Series.by_clock(df, time, metric, keys, order_by)
    elif time not in time_columns(df) and not date_parse_quality(df, [time]).first()["parse_ok"]:
        raise ValueError(f"{time} does not read as dates; name columns to order the events by")
    else:
        series = Series.by_time(df, time, metric, keys)
    fit = trend_fit(series)
    dated = horizon_steps(period, F.col("step_days"), F.col("irregular"))
    steps = F.when(F.col("last_ts").isNull(), F.lit(EVENT_STEPS.get(period, 5))).otherwise(dated)
    return series.plain(trend_forecast(fit, series.keys, F.lit(horizon) if horizon is not None else steps))


def forecast_by_order(
    df: DataFrame, order_by: Sequence[str], metric: str, keys: Sequence[str] = (), horizon: int = 5, switch: bool = True
) -> DataFrame:
    if switch:
        metric = settled_metric(df, metric, [*keys, *order_by])
    series = Series.by_order(df, order_by, metric, keys)
    return series.plain(trend_forecast(trend_fit(series), series.keys, horizon, dated=False))


# Steps ahead per period word for event series, and days per period for dated ones.
EVENT_STEPS = {"season": 10, "year": 12, "quarter": 6, "month": 5, "week": 3}
EVENT_WORDS = ["season", "match", "game", "event", "fixture"]
PERIOD_DAYS = {"year": 365, "quarter": 90, "month": 30, "week": 7}


def horizon_steps(period: str, step_days: Column, irregular: Column) -> Column:
    """Number of steps a period word stands for, given the spacing of the series.

    A word for an event counts events, however regular the series is.
    """
    event = F.lit(EVENT_STEPS.get(period, 5))
    if period in EVENT_WORDS:
        return event.cast("int")
    if period in PERIOD_DAYS:
        days = F.lit(float(PERIOD_DAYS[period])) / F.greatest(step_days, F.lit(1.0))
        dated = F.greatest(F.lit(1), F.bround(days).cast("int"))
    else:
        dated = F.lit(7 if period == "day" else 3)
    return F.when(irregular, event).otherwise(dated).cast("int")


