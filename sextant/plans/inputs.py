"""Inputs derived from the given tables, with the same text for the check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MESSY_COLUMNS = {
    "order_id": "o_orderkey",
    "total_price": (
        "case when o_orderkey % 11 = 0 then null when o_orderkey % 997 = 1 then o_totalprice * 50 "
        "else o_totalprice end"
    ),
    "priority": (
        "case when o_orderkey % 13 = 0 then null when o_orderkey % 4 = 0 then lower(o_orderpriority) "
        "else o_orderpriority end"
    ),
    "amount_text": (
        "case when o_orderkey % 17 = 0 then 'n/a' when o_totalprice >= 1000 then "
        "cast(cast(floor(o_totalprice / 1000) as bigint) as string) || ',' || "
        "lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as string), 3, '0') "
        "else cast(cast(floor(o_totalprice) as bigint) as string) end"
    ),
    "order_date_text": (
        "case when o_orderkey % 101 = 0 then 'unknown' when o_orderkey % 103 = 0 then ' ' "
        "when o_orderkey % 3 = 0 then lpad(cast(day(o_orderdate) as string), 2, '0') || '/' || "
        "lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || cast(year(o_orderdate) as string) "
        "else cast(year(o_orderdate) as string) || '-' || lpad(cast(month(o_orderdate) as string), 2, '0') "
        "|| '-' || lpad(cast(day(o_orderdate) as string), 2, '0') end"
    ),
}
MESSY_TEXTS = ["priority", "amount_text", "order_date_text"]
_MESSY_LIST = ", ".join(f"{text} as {name}" for name, text in _MESSY_COLUMNS.items())

#: CTE named ``messy`` for the check SQL.
MESSY_SQL = (
    f"with clean_half as (select {_MESSY_LIST} from orders), "
    "messy as (select * from clean_half union all select * from clean_half where order_id % 50 = 0)"
)


def messy_orders(orders: DataFrame) -> DataFrame:
    """Orders with nulls, outliers, label variants, numbers and dates as text, and exact duplicates."""
    once = orders.selectExpr(*[f"{text} as {name}" for name, text in _MESSY_COLUMNS.items()])
    copies = F.when(F.col("order_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return once.withColumn("_copy", F.explode(copies)).drop("_copy")


SKEWED_SQL = (
    "skewed as (select o_orderkey, case when o_totalprice > 480000 then 'high' else 'normal' end as size_class, "
    "case when o_orderkey % 17 = 0 then null else 'set' end as state, o_orderpriority as priority from orders)"
)


def skewed_labels(orders: DataFrame) -> DataFrame:
    """Text columns of which two are dominated by one value."""
    return orders.selectExpr(
        "o_orderkey",
        "case when o_totalprice > 480000 then 'high' else 'normal' end as size_class",
        "case when o_orderkey % 17 = 0 then null else 'set' end as state",
        "o_orderpriority as priority",
    )


MONEY_SQL = (
    "money as (select l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_extendedprice * (1 - l_discount) as net_amount, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross_amount, "
    "case when l_linenumber % 7 = 0 then null else l_quantity * l_discount end as rebate, "
    "l_returnflag, l_linestatus from lineitem)"
)
MONEY_NUMBERS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_amount", "gross_amount", "rebate",
]


def money(lineitem: DataFrame) -> DataFrame:
    """Line amounts, some of them related, one with gaps."""
    return lineitem.selectExpr(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_extendedprice * (1 - l_discount) as net_amount",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross_amount",
        "case when l_linenumber % 7 = 0 then null else l_quantity * l_discount end as rebate",
        "l_returnflag",
        "l_linestatus",
    )


def daily_events(events: DataFrame) -> DataFrame:
    return events.where("value is not null").select(F.date_trunc("day", "ts").alias("day"), "event_type", "value")


DAILY_SQL = "daily as (select date_trunc('day', ts) as day, event_type, value from events where value is not null)"

# Logged statements and questions, one per event, written from the event's own fields.
_LOG_SQL = (
    "case event_id % 9 "
    "when 0 then 'SELECT * FROM sales WHERE user_id = ' || cast(user_id as string) "
    "when 1 then 'INSERT INTO sales VALUES (' || cast(user_id as string) || ')' "
    "when 2 then 'SELECT 1; DROP TABLE t' || cast(user_id as string) "
    "when 3 then '-- note ' || event_type || chr(10) || 'WITH r AS (SELECT 1 AS a) SELECT a FROM r;' "
    "when 4 then 'SELECT last_update FROM ' || event_type "
    "when 5 then '' "
    "when 6 then 'SELECT 1; SELECT ' || cast(user_id as string) "
    "when 7 then 'EXPLAIN SELECT ' || cast(user_id as string) "
    "else '/* DROP all */ select count(*) from ' || event_type || ' ;' end"
)
_ASKED_SQL = (
    "case event_id % 5 "
    "when 0 then 'For each season, show the top ' || cast(user_id % 9 + 1 as string) || "
    "' teams, only for seasons with more than 20 matches' "
    "when 1 then 'What percentage of total ' || event_type || ' does each region contribute?' "
    "when 2 then 'Show the top ' || cast(user_id % 9 + 1 as string) || ' users' "
    "when 3 then 'Which groups have at least ' || cast(user_id as string) || ' rows?' "
    "else 'List ' || event_type || ' rows' end"
)
_ANSWERED_SQL = (
    "case event_id % 7 "
    "when 0 then 'SELECT season, AVG(goals) AS g FROM t GROUP BY season' "
    "when 1 then 'SELECT region, SUM(v) FROM t GROUP BY region HAVING COUNT(*) > 20' "
    "when 2 then 'SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY g DESC) AS rnk FROM s) "
    "WHERE rnk <= 3' "
    "when 3 then 'SELECT region, 100.0 * SUM(v) / SUM(SUM(v)) OVER () AS pct FROM t GROUP BY region' "
    "when 4 then 'SELECT u FROM t ORDER BY v DESC LIMIT ' || cast(user_id as string) "
    "when 5 then 'SELECT season, RANK() OVER (ORDER BY v DESC) AS place FROM t' "
    "else 'SELECT g, COUNT(*) AS cnt FROM t GROUP BY g' end"
)
SQL_LOG_SQL = (
    f"sql_log as (select event_id, {_LOG_SQL} as statement, {_ASKED_SQL} as question, "
    f"{_ANSWERED_SQL} as answer from events)"
)


def sql_log(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", f"{_LOG_SQL} as statement", f"{_ASKED_SQL} as question", f"{_ANSWERED_SQL} as answer"
    )
