"""Profile, cleaning, statistics, role and insight queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.dates import date_parts, parse_mixed_date
from sextant.operators import clean as C
from sextant.operators import eda
from sextant.operators import labels as L
from sextant.operators import ml, roles
from sextant.operators import profile as P
from sextant.operators import stats as S
from sextant.operators.frequencies import cardinality, value_counts_topk
from sextant.operators.insights import insights
from sextant.operators.trend import date_parse_quality
from sextant.plans.catalog import Tables, query, rounded, sql_rounded
from sextant.plans.inputs import (
    MESSY_SQL,
    MESSY_TEXTS,
    MONEY_NUMBERS,
    MONEY_SQL,
    SKEWED_SQL,
    money,
    skewed_labels,
)

_ALL = ["order_id", "total_price", *MESSY_TEXTS]


def _each(columns, text: str, joint: str = " union all ") -> str:
    return joint.join(text.format(c=c) for c in columns)


# -- types ------------------------------------------------------------------

_NUMBER = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
_CELL = "case when lower(trim({c})) in ('', 'nan', 'none', 'nat', 'null', '<na>') then null else trim({c}) end"


def _date_sql(c: str) -> str:
    cell = f"({_CELL.format(c=c)})"
    return (
        f"case when regexp_matches({cell}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast({cell} as timestamp) "
        f"when regexp_matches({cell}, '^[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{2,4}}') then coalesce("
        f"try_strptime({cell}, '%d/%m/%Y'), try_strptime({cell}, '%m/%d/%Y')) end"
    )


@query(
    "infer_types",
    MESSY_SQL
    + ", u as ("
    + _each(
        MESSY_TEXTS,
        "select '{c}' as \"column\", count(*) as n_rows, "
        "count(case when regexp_matches(trim({c}), " + _NUMBER.replace("{", "{{").replace("}", "}}") + ") then 1 end) as n_numeric, "
        "count(DATE_{c}) as n_datetime from messy",
    )
    + ") select *, case when n_numeric >= 0.8 * n_rows then 'double' when n_datetime >= 0.8 * n_rows then 'timestamp' "
    "else 'string' end as inferred from u",
)
def infer_types(t: Tables) -> DataFrame:
    return P.infer_types(t.messy)


@query(
    "numbers_as_text",
    MESSY_SQL
    + " select * from ("
    + _each(
        MESSY_TEXTS,
        "select '{c}' as \"column\", count({c}) as n_values, "
        "count(case when regexp_matches(replace(trim({c}), ',', ''), " + _NUMBER + ") then 1 end) as n_numeric, "
        "round(count(case when regexp_matches(replace(trim({c}), ',', ''), " + _NUMBER + ") then 1 end) * 1.0 / count({c}), 6) "
        "as share from messy",
    )
    + ") where share >= 0.8",
)
def numbers_as_text(t: Tables) -> DataFrame:
    return P.numbers_as_text(t.messy).withColumn("share", F.round("share", 6))


@query(
    "cast_numeric_text",
    f"{MESSY_SQL} select order_id, try_cast(replace(amount_text, ',', '') as double) as amount from messy",
)
def cast_numeric_text(t: Tables) -> DataFrame:
    return C.cast_numeric_text(t.messy).select("order_id", F.col("amount_text").alias("amount"))


@query(
    "mixed_dates",
    f"{MESSY_SQL} select order_id, strftime({_date_sql('order_date_text')}, '%Y-%m-%d %H:%M:%S') as parsed from messy",
)
def mixed_dates(t: Tables) -> DataFrame:
    parsed = parse_mixed_date(F.col("order_date_text"))
    return t.messy.select("order_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "date_parse_quality",
    MESSY_SQL
    + ", d as ("
    + _each(
        ["order_date_text", "priority"],
        "select '{c}' as \"column\", count(*) as n_total, count(CELL_{c}) as n_non_null, count(DATE_{c}) as n_parsed from messy",
    )
    + ") select *, n_non_null - n_parsed as n_failed, round((n_non_null - n_parsed) * 1.0 / n_non_null, 6) as fail_rate, "
    "n_parsed >= 3 and (n_non_null - n_parsed) * 1.0 / n_non_null <= 0.5 as parse_ok, "
    "(n_non_null - n_parsed) * 1.0 / n_non_null > 0.05 as warning from d",
)
def date_quality(t: Tables) -> DataFrame:
    found = date_parse_quality(t.messy, ["order_date_text", "priority"])
    return found.withColumn("fail_rate", F.round("fail_rate", 6))


@query(
    "date_parts",
    "select l_orderkey, l_linenumber, month(l_shipdate) as l_shipdate_month, isodow(l_shipdate) - 1 as l_shipdate_dow, "
    "year(l_shipdate) as l_shipdate_year from lineitem",
)
def parts_of_date(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", *date_parts(F.col("l_shipdate"), "l_shipdate"))


# -- profile ----------------------------------------------------------------

_MISSING = _each(
    _ALL,
    "select '{c}' as \"column\", count(*) - count({c}) as n_missing, "
    "round(100.0 * (count(*) - count({c})) / count(*), 2) as pct from messy",
)


@query("missing_profile", f"{MESSY_SQL} select * from ({_MISSING}) where n_missing > 0")
def missing_profile(t: Tables) -> DataFrame:
    return P.missing_profile(t.messy)


@query(
    "missing_heaviest",
    f"{MESSY_SQL}, m as (select order_id, case when order_id % 8 = 0 then null else priority end as note, "
    "total_price from messy) select * from ("
    + _each(
        ["note", "total_price"],
        "select '{c}' as \"column\", count(*) - count({c}) as n_missing, "
        "round(100.0 * (count(*) - count({c})) / count(*), 2) as pct from m",
    )
    + ") where pct > 10 order by n_missing desc, \"column\" limit 1",
)
def missing_heaviest(t: Tables) -> DataFrame:
    rows = t.messy.selectExpr("order_id", "case when order_id % 8 = 0 then null else priority end as note", "total_price")
    return P.missing_heaviest(rows)


@query(
    "duplicate_count",
    f"{MESSY_SQL} select count(*) as n_rows, count(*) - (select count(*) from (select distinct * from messy)) as n_duplicates "
    "from messy",
)
def duplicate_count(t: Tables) -> DataFrame:
    return P.duplicate_count(t.messy)


@query("duplicate_groups", f"{MESSY_SQL} select *, count(*) as copies from messy group by all having count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return P.duplicate_groups(t.messy)


_DESCRIBE = (
    "select '{c}' as \"column\", count({c}) as count, round(avg({c}), 4) as mean, round(median({c}), 4) as median, "
    "round(coalesce(stddev_samp({c}), 0), 4) as std, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
    "round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.75), 4) as q75 from {t}"
)
_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query(
    "describe",
    MESSY_SQL + " " + " union all ".join(_DESCRIBE.format(c=c, t="messy") for c in ("order_id", "total_price")),
)
def describe(t: Tables) -> DataFrame:
    return _round_description(P.describe(t.messy))


@query("describe_lines", " union all ".join(_DESCRIBE.format(c=c, t="lineitem") for c in _LINE_NUMBERS))
def describe_lines(t: Tables) -> DataFrame:
    return _round_description(P.describe(t.lineitem))


def _round_description(described: DataFrame) -> DataFrame:
    return described.select(
        "column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], "min", "max",
        *[F.round(c, 4).alias(c) for c in ("q25", "q75")],
    )


_FREQUENCY = "select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n from messy where {c} is not null group by {c}"


@query(
    "value_counts_topk",
    f"{MESSY_SQL}, f as ({_each(MESSY_TEXTS, _FREQUENCY)}), "
    "r as (select *, row_number() over (partition by \"column\" order by n desc, value) as rank from f) "
    "select \"column\", value, n, rank from r where rank <= 15",
)
def value_counts(t: Tables) -> DataFrame:
    return value_counts_topk(t.messy, MESSY_TEXTS, 15)


@query("cardinality", MESSY_SQL + " " + _each(_ALL, "select '{c}' as \"column\", count(distinct {c}) as n_distinct from messy"))
def distinct_values(t: Tables) -> DataFrame:
    return cardinality(t.messy)


def _fence_sql(table: str, c: str, k: float) -> str:
    return (
        f"select '{c}' as \"column\", q1 - {k} * (q3 - q1) as low, q3 + {k} * (q3 - q1) as high, n from ("
        f"select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, count({c}) as n from {table}) where q3 > q1"
    )


@query(
    "iqr_outliers",
    f"{MESSY_SQL}, b as ({_fence_sql('messy', 'order_id', 1.5)} union all {_fence_sql('messy', 'total_price', 1.5)}), "
    "v as (select 'order_id' as \"column\", cast(order_id as double) as v from messy union all "
    "select 'total_price', total_price from messy) "
    "select b.\"column\", count(*) as n_outliers, round(100.0 * count(*) / (select count(*) from messy), 2) as pct, "
    "round(low, 2) as low, round(high, 2) as high from v join b using (\"column\") where v < low or v > high group by all",
)
def iqr_outliers(t: Tables) -> DataFrame:
    return _round_fences(P.iqr_outliers(t.messy), "low", "high")


def _round_fences(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


@query(
    "outlier_rows",
    f"{MESSY_SQL}, b as ({_fence_sql('messy', 'total_price', 1.5)}) "
    "select order_id, total_price, 'total_price' as columns from messy, b where total_price < low or total_price > high",
)
def outlier_rows(t: Tables) -> DataFrame:
    found = P.outlier_rows(t.messy, ["total_price"])
    return found.select("order_id", "total_price", F.concat_ws(",", "outlier_columns").alias("columns"))


@query(
    "outlier_examples",
    f"{MESSY_SQL}, b as ({_fence_sql('messy', 'total_price', 1.5)}), "
    "o as (select total_price as v, low, high, count(*) as n from messy, b where total_price < low or total_price > high "
    "group by all), r as (select *, row_number() over (order by greatest(low - v, v - high) desc, v) as k, "
    "sum(n) over () as total from o) "
    "select 'total_price' as \"column\", cast(total as bigint) as n_outliers, "
    "round(100.0 * total / (select count(*) from messy), 2) as pct, round(low, 2) as low, round(high, 2) as high, "
    "k as example_rank, round(v, 2) as example from r where k <= 5",
)
def outlier_examples(t: Tables) -> DataFrame:
    return _round_fences(P.outlier_examples(t.messy), "low", "high", "example")


@query(
    "spike_dip",
    f"{MESSY_SQL}, b as ({_fence_sql('messy', 'total_price', 2.5)}), "
    "c as (select n, high, low, (select count(*) from messy where total_price > high) as up, "
    "(select count(*) from messy where total_price < low) as down from b) "
    "select 'total_price' as \"column\", 'spike' as kind, up as n_flagged, round(high, 2) as fence from c "
    "where up > 0 and up <= greatest(3, 0.05 * n) union all "
    "select 'total_price', 'dip', down, round(low, 2) from c where down > 0 and down <= greatest(3, 0.05 * n)",
)
def spike_dip(t: Tables) -> DataFrame:
    return _round_fences(P.spike_dip(t.messy), "fence")


@query(
    "imbalance",
    f"with {SKEWED_SQL}, f as ("
    + _each(
        ["size_class", "state", "priority"],
        "select '{c}' as \"column\", coalesce({c}, '__null__') as value, count(*) as n from skewed group by 2",
    )
    + "), r as (select *, sum(n) over (partition by \"column\") as total, count(*) over (partition by \"column\") as n_values, "
    "row_number() over (partition by \"column\" order by n desc) as k from f) "
    "select \"column\", value as top_value, round(n * 1.0 / total, 6) as top_share, n_values from r "
    "where k = 1 and n_values >= 2 and n >= 0.85 * total",
)
def imbalance(t: Tables) -> DataFrame:
    return P.imbalance(skewed_labels(t.orders)).withColumn("top_share", F.round("top_share", 6))


@query(
    "median_mode",
    MESSY_SQL
    + " "
    + _each(["order_id", "total_price"], "select '{c}' as \"column\", round(median({c}), 4) as median, null as mode from messy")
    + " union all "
    + _each(
        MESSY_TEXTS,
        "select '{c}', null, (select {c} from messy where {c} is not null group by {c} order by count(*) desc, {c} limit 1)",
    ),
)
def median_mode(t: Tables) -> DataFrame:
    return P.median_mode(t.messy).withColumn("median", F.round("median", 4))


@query(
    "histogram",
    """
    with e as (select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem),
    b as (select least(floor((l_extendedprice - low) / ((high - low) / 30)), 29) as bin, count(*) as n from lineitem, e group by 1)
    select cast(g as bigint) as bin, round(low + g * ((high - low) / 30), 2) as lower,
      round(low + (g + 1) * ((high - low) / 30), 2) as upper, coalesce(n, 0) as n
    from range(30) r(g) cross join e left join b on b.bin = g
    """,
)
def histogram(t: Tables) -> DataFrame:
    return _round_fences(P.histogram(t.lineitem, "l_extendedprice", 30), "lower", "upper")


def _r_sql(a: str, b: str) -> str:
    return f"case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end"


_UPPER = [(a, b) for i, a in enumerate(MONEY_NUMBERS) for b in MONEY_NUMBERS[i:]]


@query(
    "corr_matrix",
    f"with {MONEY_SQL} "
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, {sql_rounded(_r_sql(a, b), 3)} as r from money"
        for a in MONEY_NUMBERS
        for b in MONEY_NUMBERS
    ),
)
def corr_matrix(t: Tables) -> DataFrame:
    return P.corr_matrix(money(t.lineitem)).withColumn("r", rounded("r", 3))


@query(
    "corr_pairs",
    f"with {MONEY_SQL}, p as ("
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, {_r_sql(a, b)} as r from money" for a, b in _UPPER if a != b
    )
    + ") select col_a, col_b, round(r, 4) as r from p where abs(r) >= 0.45 order by abs(r) desc, col_a, col_b limit 5",
)
def corr_pairs(t: Tables) -> DataFrame:
    return P.corr_pairs(money(t.lineitem)).withColumn("r", F.round("r", 4))


@query(
    "corr_ranking",
    f"with {MONEY_SQL}, p as ("
    + " union all ".join(
        f"select '{c}' as \"column\", count(case when {c} is not null then 1 end) as n, {_r_sql(c, 'gross_amount')} as r from money"
        for c in MONEY_NUMBERS
        if c != "gross_amount"
    )
    + f") select \"column\", n, {sql_rounded('r', 4)} as r, case when abs(r) >= 0.7 then 'strong' "
    "when abs(r) >= 0.4 then 'moderate' else 'weak' end as strength, "
    "case when r > 0 then 'positive' else 'negative' end as direction from p where n >= 3 and r is not null",
)
def corr_ranking(t: Tables) -> DataFrame:
    ranked = S.corr_ranking(money(t.lineitem), "gross_amount")
    return ranked.select("column", "n", rounded("r", 4).alias("r"), "strength", "direction")


@query(
    "corr_ranking_coded",
    f"with {MONEY_SQL}, k as (select *, dense_rank() over (order by l_returnflag) - 1 as code from money), p as ("
    + " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, {_r_sql(c, 'code')} as r from k" for c in MONEY_NUMBERS
    )
    + f") select \"column\", n, {sql_rounded('r', 4)} as r from p",
)
def corr_ranking_coded(t: Tables) -> DataFrame:
    ranked = S.corr_ranking(money(t.lineitem), "l_returnflag")
    return ranked.select("column", "n", rounded("r", 4).alias("r"))


@query(
    "variance_rank",
    "with v as ("
    + _each(_LINE_NUMBERS, "select '{c}' as \"column\", coalesce(var_samp({c}), 0) as variance from lineitem")
    + ") select \"column\", round(variance, 4) as variance, row_number() over (order by variance desc, \"column\") as rank from v",
)
def variance_rank(t: Tables) -> DataFrame:
    return P.variance_rank(t.lineitem).withColumn("variance", F.round("variance", 4))


_FLAT_SQL = (
    "flat as (select l_quantity, 1000.0 + l_linenumber % 2 as near_constant, 7.0 as constant, "
    "cast(l_linenumber % 3 as double) as few_values from lineitem)"
)


@query(
    "low_variance",
    f"with {_FLAT_SQL}, s as ("
    + _each(
        ["l_quantity", "near_constant", "constant", "few_values"],
        "select '{c}' as \"column\", count({c}) as n, coalesce(stddev_samp({c}), 0) as std, avg(abs({c})) as mean_abs, "
        "count(distinct {c}) as d from flat",
    )
    + "), r as (select *, case when n < 2 then 'too_few' when d <= 1 or std = 0 then 'constant' "
    "when d <= 3 and mean_abs > 0 and std / mean_abs < 0.01 then 'nearly_constant' end as reason from s) "
    "select \"column\", n, round(std, 6) as std, round(mean_abs, 6) as mean_abs, reason is not null as low_variance, reason from r",
)
def low_variance(t: Tables) -> DataFrame:
    flat = t.lineitem.selectExpr(
        "l_quantity",
        "cast(1000.0 + l_linenumber % 2 as double) as near_constant",
        "cast(7.0 as double) as constant",
        "cast(l_linenumber % 3 as double) as few_values",
    )
    return P.low_variance(flat).withColumns({c: F.round(c, 6) for c in ("std", "mean_abs")})


_SCORE_FACTS = (
    f"missing as (select sum(pct) as pct from ({_MISSING})), "
    f"fence as ({_fence_sql('messy', 'order_id', 1.5)} union all {_fence_sql('messy', 'total_price', 1.5)}), "
    "flagged as (select fence.\"column\", round(100.0 * count(*) / (select count(*) from messy), 2) as pct from ("
    "select 'order_id' as \"column\", cast(order_id as double) as v from messy union all select 'total_price', total_price "
    "from messy) x join fence using (\"column\") where v < low or v > high group by all), "
    "astext as (select count(*) as k from ("
    + _each(
        MESSY_TEXTS,
        "select count(case when regexp_matches(replace(trim({c}), ',', ''), " + _NUMBER + ") then 1 end) * 1.0 / count({c}) as s "
        "from messy",
    )
    + ") where s >= 0.8), "
    "dup as (select count(*) as n, count(*) - (select count(*) from (select distinct * from messy)) as d from messy)"
)


@query(
    "quality_score",
    f"{MESSY_SQL}, {_SCORE_FACTS}, p as (select n as n_rows, cast(5 as bigint) as n_columns, "
    "least(30.0, (select pct from missing) / 5) as a, least(20.0, 100.0 * d / n) as b, "
    "cast(least(15.0, 5.0 * (select k from astext)) as double) as c, "
    "least(15.0, coalesce((select avg(pct) from flagged), 0) * 0.3) as e from dup) "
    "select n_rows, n_columns, round(a, 4) as missing_penalty, round(b, 4) as duplicate_penalty, c as type_penalty, "
    "round(e, 4) as outlier_penalty, greatest(0.0, round(100.0 - a - b - c - e, 1)) as score from p",
)
def quality_score(t: Tables) -> DataFrame:
    scored = P.quality_score(t.messy)
    return scored.withColumns({c: F.round(c, 4) for c in ("missing_penalty", "duplicate_penalty", "outlier_penalty")})


# -- cleaning ---------------------------------------------------------------

_CLEANED = (
    "one as (select distinct * from messy), "
    "num as (select order_id, total_price, priority, try_cast(replace(amount_text, ',', '') as double) as amount_text, "
    "order_date_text from one), "
    "fill as (select median(total_price) as price, median(amount_text) as amount, "
    "(select priority from num where priority is not null group by 1 order by count(*) desc, priority limit 1) as label from num)"
)


@query(
    "auto_clean",
    f"{MESSY_SQL}, {_CLEANED} select order_id, round(coalesce(total_price, price), 4) as total_price, "
    "coalesce(priority, label) as priority, round(coalesce(amount_text, amount), 4) as amount_text, order_date_text "
    "from num, fill",
)
def auto_clean(t: Tables) -> DataFrame:
    cleaned = C.auto_clean(t.messy).data
    return cleaned.withColumns({c: F.round(c, 4) for c in ("total_price", "amount_text")})


@query(
    "auto_clean_log",
    f"{MESSY_SQL}, {_CLEANED} "
    "select cast(1 as bigint) as step, 'drop_duplicates' as action, null as \"column\", "
    "(select count(*) from messy) - (select count(*) from one) as n_cells, null as label, null as number union all "
    "select 2, 'cast_to_number', 'amount_text', null, null, null union all "
    "select 3, 'impute_median', 'total_price', (select count(*) from num where total_price is null), null, round(price, 4) from fill "
    "union all select 4, 'impute_mode', 'priority', (select count(*) from num where priority is null), label, null from fill "
    "union all select 5, 'impute_median', 'amount_text', (select count(*) from num where amount_text is null), null, "
    "round(amount, 4) from fill",
)
def auto_clean_log(t: Tables) -> DataFrame:
    log = C.auto_clean(t.messy).log
    median = F.col("action") == "impute_median"
    return log.select(
        "step", "action", "column", "n_cells",
        F.when(~median, F.col("fill")).alias("label"),
        F.round(F.when(median, F.col("fill").try_cast("double")), 4).alias("number"),
    )


_LABEL_GROUPS = (
    "l as (select trim(priority) as label, count(*) as n from messy where trim(priority) <> '' group by 1), "
    "p as (select *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as plain from l), "
    "g as (select plain, min(struct_pack(a := -n, b := label)) as first, string_agg(label, ' | ' order by label) as labels, "
    "cast(sum(n) as bigint) as n_rows from p group by plain having count(*) > 1)"
)


@query(
    "quality_suggestions",
    f"{MESSY_SQL}, {_LABEL_GROUPS}, b as ({_fence_sql('messy', 'total_price', 1.5)}), "
    "facts as (select count(*) as n, (select count(*) from (select distinct * from messy)) as d, count(total_price) as prices, "
    "count(priority) as priorities, (select count(*) from messy, b where total_price < low or total_price > high) as outside, "
    "(select count(*) from g) as groups from messy) "
    "select 'drop_duplicates' as action, null as \"column\", cast(n - d as double) as amount, true as auto from facts where n > d "
    "union all select 'impute_median', 'total_price', round(100.0 * (n - prices) / n, 2), true from facts where n > prices "
    "union all select 'impute_mode', 'priority', round(100.0 * (n - priorities) / n, 2), true from facts where n > priorities "
    "union all select 'fix_dtype', 'amount_text', 1.0, true "
    "union all select 'review_outliers', 'total_price', outside, false from facts where outside > 0 "
    "union all select 'review_categories', 'priority', groups, false from facts where groups > 0",
)
def quality_suggestions(t: Tables) -> DataFrame:
    return C.quality_suggestions(t.messy)


@query(
    "quality_decisions",
    f"{MESSY_SQL}, {_LABEL_GROUPS} select 'category_merge' as type, 'priority' as \"column\", "
    "row_number() over (order by first) as group_no, labels, first.b as \"primary\", n_rows from g "
    "union all select 'id_or_feature', 'order_id', 0, '', null, null",
)
def quality_decisions(t: Tables) -> DataFrame:
    return C.quality_decisions(t.messy).withColumn("labels", F.concat_ws(" | ", "labels"))


# The five priorities are unlike each other, so a group is what has one normal form.
@query(
    "near_dup_labels",
    f"""
    {MESSY_SQL}, l as (select trim(priority) as label, count(*) as n from messy where trim(priority) <> '' group by 1),
    p as (select *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as plain from l),
    g as (select plain, min(struct_pack(a := -n, b := label)) as first from p group by plain having count(*) > 1),
    k as (select plain, row_number() over (order by first) as group_no from g)
    select 'priority' as "column", group_no, label, n from p join k using (plain)
    """,
)
def near_dup_labels(t: Tables) -> DataFrame:
    return L.similar_label_groups(t.messy)


# Names of one customer segment differ in digits alone: far more labels than a category has, in few groups.
@query("near_dup_labels_many")
def near_dup_labels_many(t: Tables) -> DataFrame:
    return L.similar_label_groups(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), ["c_name", "n_name"])


@query(
    "label_columns",
    "select * from (values ('priority', 'categories'), ('amount_text', 'numbers'), ('order_date_text', 'timestamp')) as v(\"column\", status)",
)
def label_columns(t: Tables) -> DataFrame:
    return L.category_columns(t.messy)


@query(
    "near_dup_label_pairs",
    f"""
    {MESSY_SQL}, l as (select distinct trim(priority) as label,
        regexp_replace(lower(trim(priority)), '[^a-z0-9]', '', 'g') as plain from messy where trim(priority) <> '')
    select 'priority' as "column", a.label as label_a, b.label as label_b from l a join l b on a.label < b.label
    where a.plain <> '' and b.plain <> '' and (levenshtein(a.plain, b.plain) <= 2
      or ((contains(a.plain, b.plain) or contains(b.plain, a.plain)) and least(length(a.plain), length(b.plain)) >= 2))
    """,
)
def near_dup_label_pairs(t: Tables) -> DataFrame:
    return L.similar_label_pairs(t.messy, MESSY_TEXTS)


@query(
    "id_like_columns",
    f"{MESSY_SQL}, n as (select count(*) as rows, count(distinct order_id) as a, count(distinct total_price) as b from messy) "
    "select * from (select 'order_id' as \"column\", true as by_name, a >= greatest(20, floor(0.9 * rows)) as by_uniqueness from n "
    "union all select 'total_price', false, b >= greatest(20, floor(0.9 * rows)) from n) where by_name or by_uniqueness",
)
def id_like_columns(t: Tables) -> DataFrame:
    return C.id_like_columns(t.messy)


@query(
    "category_merge",
    f"{MESSY_SQL} select order_id, case when priority in ('1-urgent', '1-URGENT', '2-high') then 'URGENT' else priority end "
    "as priority from messy",
)
def category_merge(t: Tables) -> DataFrame:
    rows = t.messy.select("order_id", "priority")
    return C.merge_labels(rows, "priority", ["1-urgent", "1-URGENT", "2-high"], "URGENT")


@query("apply_label_map", f"{MESSY_SQL} select order_id, upper(priority) as priority from messy")
def apply_label_map(t: Tables) -> DataFrame:
    """Merge decisions found in the data and confirmed with the upper-case label as primary."""
    rows = t.messy.select("order_id", "priority")
    merges = C.quality_decisions(rows).withColumn("primary", F.upper("primary"))
    return C.apply_label_map(rows, C.decisions_to_label_map(merges), ["priority"])


# -- tests ------------------------------------------------------------------


@query(
    "welch_t",
    """
    with g as (select l_linestatus as grp, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v
               from lineitem group by 1),
    p as (select a.grp as group_a, b.grp as group_b, a.n as n_a, b.n as n_b, a.m as mean_a, b.m as mean_b,
            a.v / a.n as va, b.v / b.n as vb from g a join g b on a.grp < b.grp)
    select group_a, group_b, n_a, n_b, round(mean_a, 4) as mean_a, round(mean_b, 4) as mean_b,
      round((mean_a - mean_b) / sqrt(va + vb), 6) as t,
      round((va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 2) as dof from p
    """,
)
def welch_t(t: Tables) -> DataFrame:
    tested = S.welch_t(t.lineitem, "l_linestatus", "l_extendedprice")
    return tested.select(
        "group_a", "group_b", "n_a", "n_b", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
        F.round("t", 6).alias("t"), F.round("dof", 2).alias("dof"),
    )


@query(
    "anova_f",
    """
    with g as (select l_returnflag as grp, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v
               from lineitem group by 1),
    w as (select sum(n * m) / sum(n) as grand from g),
    s as (select count(*) as n_groups, cast(sum(n) as bigint) as n_total, sum(n * (m - grand) * (m - grand)) as ssb,
            sum((n - 1) * v) as ssw from g, w)
    select n_groups, n_total, n_groups - 1 as df1, n_total - n_groups as df2,
      round((ssb / (n_groups - 1)) / (ssw / (n_total - n_groups)), 6) as f from s
    """,
)
def anova_f(t: Tables) -> DataFrame:
    tested = S.anova_f(t.lineitem, "l_returnflag", "l_extendedprice")
    return tested.select("n_groups", "n_total", "df1", "df2", F.round("f", 6).alias("f"))


@query("group_significance")
def group_significance(t: Tables) -> DataFrame:
    two = S.compare_groups(t.lineitem, "l_linestatus", "l_extendedprice")
    return two.unionByName(S.compare_groups(t.lineitem, "l_returnflag", "l_extendedprice"))


# -- roles and features -----------------------------------------------------


@query(
    "date_column_scores",
    MESSY_SQL
    + ", d as ("
    + _each(
        MESSY_TEXTS,
        "select '{c}' as \"column\", false as is_timestamp, count(CELL_{c}) as n_non_null, count(DATE_{c}) as n_parsed, "
        "count(case when regexp_matches(CELL_{c}, '[0-9]{{4}}|[0-9]{{1,2}}[/-][0-9]{{1,2}}') then 1 end) as shaped_n from messy",
    )
    + ") select \"column\", is_timestamp, n_non_null, n_parsed, round(shaped_n * 1.0 / n_non_null, 6) as shaped, "
    "round(n_parsed * 1.0 / n_non_null + case when \"column\" = 'order_date_text' then 0.2 else 0 end, 6) as score from d "
    "where shaped_n * 1.0 / n_non_null >= 0.4 and n_parsed >= 3 and n_parsed * 1.0 / n_non_null > 0.5",
)
def date_column_scores(t: Tables) -> DataFrame:
    scores = roles.date_column_scores(t.messy)
    return scores.withColumns({c: F.round(c, 6) for c in ("shaped", "score")})


_ROLES = {
    # column: (kind, looks like a metric, looks like a dimension, default metric, default target)
    "order_id": ("numeric", False, True, False, False),
    "total_price": ("numeric", True, False, True, True),
    "priority": ("categorical", False, False, False, False),
    "amount_text": ("categorical", True, False, False, False),
    "order_date_text": ("categorical", False, False, False, False),
}


@query(
    "column_roles",
    MESSY_SQL
    + " "
    + " union all ".join(
        f"select '{c}' as \"column\", '{kind}' as kind, count(distinct {c}) as n_distinct, {metric} as metric_name, "
        f"{dimension} as dimension_name, {default} as default_metric, {target} as default_target from messy"
        for c, (kind, metric, dimension, default, target) in _ROLES.items()
    ),
)
def column_roles(t: Tables) -> DataFrame:
    return roles.column_roles(t.messy)


@query(
    "suggested_groupings",
    f"with {MONEY_SQL}, c as ("
    + _each(["l_returnflag", "l_linestatus"], "select '{c}' as group_col, count(distinct {c}) as n_levels from money")
    + "), m as ("
    + " union all ".join(
        f"select '{c}' as metric_col, count(distinct {c}) as k, {i} as place, "
        f"{0 if any(p in c for p in ('price', 'amount')) else 1} as tier from money"
        for i, c in enumerate(MONEY_NUMBERS)
    )
    + "), r as (select group_col, metric_col, n_levels, row_number() over (order by n_levels, tier, k desc, place) as position "
    "from c, m where n_levels between 2 and 30) "
    "select position, group_col, metric_col, 'mean' as agg, n_levels from r where position <= 3",
)
def suggested_groupings(t: Tables) -> DataFrame:
    return roles.suggested_groupings(money(t.lineitem))


@query(
    "insights",
    f"{MESSY_SQL}, b as ({_fence_sql('messy', 'total_price', 2.5)}), "
    "c as (select n, (select count(*) from messy where total_price > high) as up, "
    "(select count(*) from messy where total_price < low) as down from b), "
    "r as (select 2 as k, 'comparison' as kind, 'priority' as column_a, 'total_price' as column_b, cast(null as double) as value "
    "union all select 3, 'modeling', 'total_price', null, null union all select 4, 'ranking', 'priority', 'order_id', null "
    "union all select 5, 'spike', 'total_price', null, up from c where up > 0 and up <= greatest(3, 0.05 * n) "
    "union all select 6, 'dip', 'total_price', null, down from c where down > 0 and down <= greatest(3, 0.05 * n)) "
    "select row_number() over (order by k) as position, kind, column_a, column_b, value from r",
)
def insight_rows(t: Tables) -> DataFrame:
    return insights(t.messy)


_PARTS = "order_date_text_month order_date_text_dow order_date_text_year".split()


@query(
    "feature_prep",
    f"{MESSY_SQL}, p as (select order_id, total_price, priority, {_date_sql('order_date_text')} as d from messy), "
    "f as (select order_id, total_price, priority, cast(month(d) as double) as m, cast(isodow(d) - 1 as double) as w, "
    "cast(year(d) as double) as y from p), "
    "x as (select median(total_price) as tp, median(m) as mm, median(w) as mw, median(y) as my from f) "
    "select order_id, round(coalesce(total_price, tp), 4) as total_price, coalesce(priority, 'missing') as priority, "
    "coalesce(m, mm) as order_date_text_month, coalesce(w, mw) as order_date_text_dow, coalesce(y, my) as order_date_text_year "
    "from f, x",
)
def feature_prep(t: Tables) -> DataFrame:
    prepared = ml.prepare_features(t.messy, keep=["order_id"])
    return prepared.data.withColumn("total_price", F.round("total_price", 4))


@query(
    "zscore",
    "with s as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_extendedprice) as mp, "
    "stddev_pop(l_extendedprice) as sp from lineitem) select l_orderkey, l_linenumber, "
    f"{sql_rounded('(l_quantity - mq) / sq', 6)} as l_quantity, {sql_rounded('(l_extendedprice - mp) / sp', 6)} as l_extendedprice "
    "from lineitem, s",
)
def zscore(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = ml.zscore(rows, ["l_quantity", "l_extendedprice"])
    return scaled.withColumns({c: rounded(c, 6) for c in ("l_quantity", "l_extendedprice")})


def _expand_markers() -> None:
    """Put the cell and date expressions into the check SQL written with CELL_ and DATE_ markers."""
    from sextant.plans.catalog import ORACLES

    for name in ("infer_types", "date_parse_quality", "date_column_scores"):
        sql = ORACLES[name]
        for c in MESSY_TEXTS:
            sql = sql.replace(f"CELL_{c}", f"({_CELL.format(c=c)})").replace(f"DATE_{c}", _date_sql(c))
        ORACLES[name] = sql


_expand_markers()


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_ORDER_PAIRS = [("o_orderkey", "o_custkey"), ("o_orderkey", "o_totalprice"), ("o_custkey", "o_totalprice")]
_EDA_PARTS = [
    *[f"select 'missing' as section, '{c}' as \"column\", null as key, count(*) - count({c}) as n, "
      f"100.0 * (count(*) - count({c})) / count(*) as value from orders" for c in _ORDER_COLUMNS],
    *[f"select 'describe', '{c}', '{key}', count({c}), {stat}({c}) from orders"
      for c in _ORDER_NUMBERS for key, stat in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))],
    *[f"select 'correlation', '{a}', '{b}', count(*), corr({a}, {b}) from orders" for a, b in _ORDER_PAIRS],
    *[f"select 'value_counts', '{c}', {c}, count(*), null from orders group by {c}" for c in ("o_orderstatus", "o_orderpriority")],
    *[f"select 'histogram', '{c}', cast(cast(least(floor(({c} - low) / ((high - low) / 30)), 29) as bigint) as varchar), count(*), null "
      f"from orders, (select cast(min({c}) as double) as low, cast(max({c}) as double) as high from orders) group by 3"
      for c in _ORDER_NUMBERS],
    *[f"select 'group_mean', '{c} by o_orderstatus', o_orderstatus, count({c}), avg({c}) from orders group by 3"
      for c in ("o_totalprice", "o_orderkey", "o_custkey")],
    *[f"select 'daily_mean', '{c} by o_orderdate', strftime(o_orderdate, '%Y-%m-%d'), count({c}), avg({c}) from orders group by 3"
      for c in _ORDER_NUMBERS],
]


@query(
    "eda_sections",
    f"select section, \"column\", key, n, {sql_rounded('value', 6)} as value from ({' union all '.join(_EDA_PARTS)})",
)
def eda_sections(t: Tables) -> DataFrame:
    return eda.eda_sections(t.orders).withColumn("value", rounded("value", 6))


@query(
    "task_types",
    " union all ".join(
        f"select '{c}' as target, case when {str(c in _ORDER_NUMBERS).lower()} and count(distinct {c}) > 10 "
        "then 'regression' else 'classification' end as task from orders"
        for c in _ORDER_COLUMNS
    ) + " union all select null, 'clustering'",
)
def task_types(t: Tables) -> DataFrame:
    """What kind of model each column would be a target of; without a target, clusters."""
    rows = [(c, roles.task_type(t.orders, c)) for c in [*t.orders.columns, None]]
    return t.spark.createDataFrame(rows, "target string, task string")


@query(
    "default_test_pair",
    "select case when count(distinct o_orderstatus) <= count(distinct o_orderpriority) then 'o_orderstatus' "
    "else 'o_orderpriority' end as group_col, 'o_totalprice' as metric_col from orders",
)
def default_test_pair(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([roles.default_test_pair(t.orders)], "group_col string, metric_col string")
