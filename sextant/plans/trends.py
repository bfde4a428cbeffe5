"""Trend queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import trend as T
from sextant.plans.catalog import ORACLES, Tables, query, rounded, sql_rounded
from sextant.plans.inputs import DAILY_SQL, daily_events


def _fit_sql(points: str, keys: str) -> str:
    """CTEs from (keys, ts, y) points to one fitted row per key, ``fit``."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
    pts as ({points}),
    gap as (select {keys}, ts, y, (epoch_us(ts) - epoch_us(min(ts) over (partition by {keys}))) / 86400000000.0 as t,
        (epoch_us(ts) - epoch_us(lag(ts) over (partition by {keys} order by ts))) / 86400000000.0 as g from pts),
    gaps as (select {keys}, count(g) as n_gaps, avg(g) as mean_gap, stddev_pop(g) as std_gap, median(g) as median_gap,
        max(g) as max_gap from gap group by {keys}),
    spaced as (select *, n_gaps >= 2 and (mean_gap <= 0 or (median_gap > 0 and max_gap / median_gap >= 3)
        or (mean_gap > 0 and std_gap / mean_gap >= 0.35)) as irregular,
        case when median_gap > 0 then median_gap else 1.0 end as step_days from gaps),
    line as (select {keys}, count(*) as n, max(ts) as last_ts, max(t) as last_t, avg(y) as my, min(y) as miny, max(y) as maxy,
        coalesce(case when regr_sxx(y, t) > 0 then regr_sxy(y, t) / regr_sxx(y, t) end, 0) as slope, avg(t) as mt,
        stddev_pop(y) as sdy, coalesce(stddev_samp(y) < 0.01 * avg(abs(y)) and count(distinct y) <= 3, false) as nearly
        from gap group by {keys}),
    line2 as (select *, my - slope * mt as intercept from line),
    res as (select {', '.join('a.' + k for k in keys.split(', '))}, sum(power(y - intercept - slope * t, 2)) as sse, sum(power(y - my, 2)) as sst
        from gap a join line2 b on {on} group by all),
    fit as (select a.*, spaced.irregular, spaced.step_days, case when sst > 0 then 1 - sse / sst end as r2,
        case when sqrt(sse / (case when n > 2 then n - 2 else n end)) > 0
             then sqrt(sse / (case when n > 2 then n - 2 else n end)) else greatest(abs(my) * 0.05, 1e-6) end as resid_std,
        miny >= -1e-12 as nonnegative,
        case when n < 3 then 'too_few' when sdy < 1e-9 then 'constant' when nearly then 'nearly_constant' else 'ok' end as status
        from line2 a join res b on {on} join spaced on {on.replace('b.', 'spaced.')})
    """


_BY_TYPE = _fit_sql("select event_type, day as ts, avg(value) as y from daily group by 1, 2", "event_type")
_OVERALL = _fit_sql("select 1 as k, day as ts, avg(value) as y from daily group by 1, 2", "k")
_BY_USER = _fit_sql("select user_id, ts, avg(value) as y from events where value is not null group by 1, 2", "user_id")


def _by_type(t: Tables) -> T.Series:
    return T.Series.by_time(daily_events(t.events), "day", "value", ["event_type"])


def _by_user(t: Tables) -> T.Series:
    return T.Series.by_time(t.events.select("user_id", "ts", "value"), "ts", "value", ["user_id"])


@query(
    "irregular_spacing",
    f"with {_BY_USER} select user_id, n_gaps, round(mean_gap, 6) as mean_gap, round(std_gap, 6) as std_gap, "
    "round(median_gap, 6) as median_gap, round(max_gap, 6) as max_gap, irregular from spaced",
)
def irregular_spacing(t: Tables) -> DataFrame:
    found = T.spacing(_by_user(t))
    return found.select(
        "user_id", "n_gaps", *[F.round(c, 6).alias(c) for c in ("mean_gap", "std_gap", "median_gap", "max_gap")], "irregular"
    )


_FIT_COLUMNS = (
    f"n, {sql_rounded('slope', 6)} as slope, round(intercept, 4) as intercept, {sql_rounded('r2', 6)} as r2, "
    "round(resid_std, 4) as resid_std, step_days, irregular, status"
)


@query("trend_fit", f"with {DAILY_SQL}, {_BY_TYPE} select event_type, {_FIT_COLUMNS} from fit")
def trend_fit(t: Tables) -> DataFrame:
    fit = T.trend_fit(_by_type(t))
    return fit.select(
        "event_type", "n", rounded("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
        rounded("r2", 6).alias("r2"), F.round("resid_std", 4).alias("resid_std"), "step_days", "irregular", "status",
    )


_AHEAD = (
    "ahead as (select fit.*, h, intercept + slope * (last_t + step_days * h) as point, "
    "1.96 * resid_std * (1 + 0.1 * h) as half from fit, (select unnest(range(1, 37)) as h) where status = 'ok' and h <= {steps})"
)
_ROWS = (
    "cast(h as bigint) as h, case when irregular then 'Event +' || cast(h as varchar) else "
    "strftime(last_ts + to_microseconds(cast(round(step_days * h * 86400000000.0) as bigint)), '%Y-%m-%d') end as period, "
    + ", ".join(
        f"round(case when nonnegative then greatest({e}, 0) else {e} end, 4) as {name}"
        for e, name in (("point", "forecast"), ("point - half", "lower_95"), ("point + half", "upper_95"))
    )
)


def _rounded_forecast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("forecast", "lower_95", "upper_95")})


@query("trend_forecast", f"with {DAILY_SQL}, {_OVERALL}, {_AHEAD.format(steps=6)} select {_ROWS} from ahead")
def trend_forecast(t: Tables) -> DataFrame:
    return _rounded_forecast(T.forecast_by_time(daily_events(t.events), "day", "value", horizon=6))


@query(
    "trend_forecast_by_group",
    f"with {DAILY_SQL}, {_BY_TYPE}, {_AHEAD.format(steps='(case when irregular then 3 else 7 end)')} "
    f"select event_type, {_ROWS} from ahead",
)
def trend_forecast_by_group(t: Tables) -> DataFrame:
    return _rounded_forecast(
        T.forecast_by_time(daily_events(t.events), "day", "value", ["event_type"], period="week")
    )


@query(
    "trend_forecast_events",
    "with pts as (select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as t, value as y "
    "from events where value is not null), "
    "line as (select event_type, count(*) as n, max(t) as last_t, regr_slope(y, t) as slope, regr_intercept(y, t) as intercept, "
    "min(y) as miny from pts group by 1), "
    "res as (select pts.event_type, sqrt(sum(power(y - intercept - slope * t, 2)) / (any_value(n) - 2)) as s "
    "from pts join line using (event_type) group by 1), "
    "ahead as (select event_type, h, intercept + slope * (last_t + h) as point, 1.96 * s * (1 + 0.1 * h) as half, "
    "miny >= -1e-12 as nonnegative, true as irregular, cast(null as timestamp) as last_ts, 1.0 as step_days "
    "from line join res using (event_type), (select unnest(range(1, 6)) as h)) "
    f"select event_type, {_ROWS} from ahead",
)
def trend_forecast_events(t: Tables) -> DataFrame:
    """Series without a time axis: the event number is the position."""
    rows = t.events.select("event_type", "ts", "event_id", "value")
    return _rounded_forecast(T.forecast_by_order(rows, ["ts", "event_id"], "value", ["event_type"], horizon=5))


@query("trend_fallback", ORACLES["trend_forecast_events"])
def trend_fallback(t: Tables) -> DataFrame:
    """Times that cannot be read as dates: the forecast goes by the order of the events."""
    rows = t.events.select("event_type", "ts", "event_id", "value", F.concat(F.lit("no date "), "event_id").alias("when"))
    return _rounded_forecast(
        T.forecast_by_time(rows, "when", "value", ["event_type"], horizon=5, order_by=["ts", "event_id"])
    )


_DATED_TYPES = "('click', 'view')"


@query(
    "trend_fallback_mixed",
    f"select * from (with {DAILY_SQL}, {_BY_TYPE}, {_AHEAD.format(steps=5)} select event_type, {_ROWS} from ahead) "
    f"where event_type in {_DATED_TYPES} union all "
    f"select * from ({ORACLES['trend_forecast_events']}) where event_type not in {_DATED_TYPES}",
)
def trend_fallback_mixed(t: Tables) -> DataFrame:
    """Some series have dates and some have none: each goes by its own clock, in one job."""
    day = F.when(F.expr(f"event_type in {_DATED_TYPES}"), F.date_format("ts", "dd/MM/yyyy")).otherwise(F.lit("some day"))
    rows = t.events.select("event_type", "ts", "event_id", "value", day.alias("when"))
    return _rounded_forecast(
        T.forecast_by_time(rows, "when", "value", ["event_type"], horizon=5, order_by=["ts", "event_id"])
    )


@query(
    "trend_status",
    f"with {_BY_USER} select user_id, n, status from fit",
)
def trend_status(t: Tables) -> DataFrame:
    return T.trend_fit(_by_user(t)).select("user_id", "n", "status")


_WORDS = ["year", "season", "quarter", "month", "week", "day", ""]


def _steps_sql(word: str) -> str:
    event = {"year": 12, "quarter": 6, "month": 5, "week": 3}.get(word, 5)
    if word == "season":
        return "cast(10 as int) as steps_season"
    days = {"year": 365, "quarter": 90, "month": 30, "week": 7}.get(word)
    dated = f"greatest(1, cast(round_even({days} / greatest(step_days, 1.0), 0) as int))" if days else (7 if word == "day" else 3)
    return f"cast(case when irregular then {event} else {dated} end as int) as steps_{word or 'default'}"


@query(
    "horizon_steps",
    f"with {DAILY_SQL}, {_BY_TYPE} select event_type, {', '.join(_steps_sql(w) for w in _WORDS)} from fit",
)
def horizon_steps(t: Tables) -> DataFrame:
    spaced = T.spacing(_by_type(t))
    steps = [
        T.horizon_steps(w, F.col("step_days"), F.col("irregular")).alias(f"steps_{w or 'default'}") for w in _WORDS
    ]
    return spaced.select("event_type", *steps)
