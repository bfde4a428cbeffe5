"""Relational queries: joins, thresholds, ranks, shares, sets, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import relational as R
from sextant.operators.difference import table_diff as table_differences
from sextant.operators.joinkeys import discover_join_keys
from sextant.plans.catalog import Tables, query, rounded, sql_rounded
from sextant.plans.inputs import MESSY_SQL
from sextant.scratch import materialize
from sextant.sources.names import clean_columns
from sextant.sources.registry import TableRegistry, catalog_overview, row_counts, same_content, table_schema


@query(
    "multi_clause_topn",
    """
    with seg as (
      select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by c_mktsegment),
    s as (
      select c.c_mktsegment as segment, n.n_name as nation, avg(o.o_totalprice) as avg_total, count(*) as n_orders
      from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
      where c.c_mktsegment in (select c_mktsegment from seg where n > (select avg(n) from seg))
      group by c.c_mktsegment, n.n_name),
    r as (select *, row_number() over (partition by segment order by avg_total desc, nation) as rnk from s)
    select segment, nation, round(avg_total, 4) as avg_total, n_orders, cast(rnk as bigint) as rnk
    from r where rnk <= 3
    """,
)
def multi_clause_topn(t: Tables) -> DataFrame:
    """Segments with more orders than the mean per segment; in each the 3 nations of highest average order.

    Orders are averaged per customer before any join, so the joins and the
    ranking see customers, not orders. The small grain is written once because
    the threshold, the mean and the ranking all read it.
    """
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n_priced"), F.count("*").alias("n_orders")
    )
    placed = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    grain = placed.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(
        (F.sum("total") / F.sum("n_priced")).alias("avg_total"), F.sum("n_orders").alias("n_orders")
    )
    grain = materialize(grain, "grain")
    per_segment = grain.groupBy("segment").agg(F.sum("n_orders").alias("n"))
    good = per_segment.where(F.col("n") > per_segment.agg(F.avg("n")).scalar())
    ranked = R.top_n_per_group(grain.join(good, "segment", "left_semi"), ["segment"], "avg_total", 3, ["nation"])
    return ranked.select("segment", "nation", F.round("avg_total", 4).alias("avg_total"), "n_orders", "rnk")


@query(
    "topn_per_group",
    """
    with g as (select s_nationkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
               from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, s_name)
    select s_nationkey, s_name, revenue, cast(rnk as bigint) as rnk from (
      select *, row_number() over (partition by s_nationkey order by revenue desc, s_name) as rnk from g) where rnk <= 3
    """,
)
def topn_per_group(t: Tables) -> DataFrame:
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    named = (
        per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "s_name")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    )
    return R.top_n_per_group(named, ["s_nationkey"], "revenue", 3, ["s_name"])


def _ranked(function: str) -> str:
    return f"""
    with g as (select c_mktsegment, o_custkey, count(*) as n from orders join customer on o_custkey = c_custkey
               group by c_mktsegment, o_custkey)
    select c_mktsegment, o_custkey, n, cast(rnk as bigint) as rnk from (
      select *, {function}() over (partition by c_mktsegment order by n desc) as rnk from g) where rnk <= 3
    """


def _orders_per_customer(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counted.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_custkey", "n")


@query("rank_ties", _ranked("rank"))
def rank_ties(t: Tables) -> DataFrame:
    return R.top_n_per_group(_orders_per_customer(t), ["c_mktsegment"], "n", 3, ranking="rank")


@query("dense_rank_ties", _ranked("dense_rank"))
def dense_rank_ties(t: Tables) -> DataFrame:
    return R.top_n_per_group(_orders_per_customer(t), ["c_mktsegment"], "n", 3, ranking="dense_rank")


@query(
    "join_agg",
    """
    select p_brand, count(*) as n_lines, round(sum(l_quantity), 2) as quantity,
           round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from lineitem join part on l_partkey = p_partkey group by p_brand
    """,
)
def join_agg(t: Tables) -> DataFrame:
    """Lines are summed per part before the join, so it carries one row per part."""
    per_part = t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("n_lines"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    return (
        per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(
            F.sum("n_lines").alias("n_lines"),
            F.round(F.sum("quantity"), 2).alias("quantity"),
            F.round(F.sum("revenue"), 2).alias("revenue"),
        )
    )


@query(
    "semi_join_groups",
    """
    select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (
      select o_custkey from orders group by o_custkey having count(*) > 14)
    """,
)
def semi_join_groups(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return R.qualifying_groups(rows, ["o_custkey"], F.count("*") > 14).select(*rows.columns)


@query(
    "having_threshold",
    """
    select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders
    where o_orderstatus <> 'P' group by o_custkey having count(*) > 10 and avg(o_totalprice) > 200000
    """,
)
def having_threshold(t: Tables) -> DataFrame:
    kept = t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.avg("o_totalprice").alias("mean"),
    )
    return kept.where("n_orders > 10 and mean > 200000").drop("mean")


@query(
    "left_join_null_fill",
    """
    select c_custkey, coalesce(count(o_orderkey), 0) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as total
    from customer left join orders on c_custkey = o_custkey group by c_custkey
    """,
)
def left_join_null_fill(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total")
    )
    return t.customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey",
        F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"),
        F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"),
    )


@query(
    "anti_join_orphans",
    "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey "
    "and o_orderstatus = 'P' and o_totalprice > 250000)",
)
def anti_join_orphans(t: Tables) -> DataFrame:
    large = t.orders.where("o_orderstatus = 'P' and o_totalprice > 250000").select("o_custkey").distinct()
    return t.customer.select("c_custkey", "c_name").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(
    "right_join_agg",
    "select n_name, coalesce(n_suppliers, 0) as n_suppliers from (select s_nationkey, count(*) as n_suppliers from supplier "
    "where s_acctbal > 0 group by 1) right join nation on s_nationkey = n_nationkey",
)
def right_join_agg(t: Tables) -> DataFrame:
    counted = t.supplier.where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    return counted.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select(
        "n_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers")
    )


@query(
    "full_join_counts",
    "with a as (select o_custkey as custkey, count(*) as n_large from orders where o_totalprice > 300000 group by 1), "
    "b as (select c_custkey as custkey, c_acctbal from customer where c_acctbal < 5000) "
    "select custkey, n_large, c_acctbal from a full join b using (custkey)",
)
def full_join_counts(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_large"))
    poor = t.customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    return large.join(poor, "custkey", "full").select("custkey", "n_large", "c_acctbal")


@query(
    "self_join_pairs",
    "select a.n_name as nation_a, b.n_name as nation_b from nation a join nation b "
    "on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name",
)
def self_join_pairs(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    same = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))
    return a.join(b, same).select(F.col("a.n_name").alias("nation_a"), F.col("b.n_name").alias("nation_b"))


@query(
    "theta_band_join",
    """
    with bands as (select n_name, n_nationkey * 20000.0 as low, (n_nationkey + 1) * 20000.0 as high from nation)
    select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total
    from orders join bands on o_totalprice >= low and o_totalprice < high group by n_name
    """,
)
def theta_band_join(t: Tables) -> DataFrame:
    bands = t.nation.select(
        "n_name",
        (F.col("n_nationkey") * 20000.0).alias("low"),
        ((F.col("n_nationkey") + 1) * 20000.0).alias("high"),
    )
    return (
        R.band_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "low", "high", 20000.0)
        .groupBy("n_name")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "pct_of_total",
    """
    select c_mktsegment, round(sum(o_totalprice), 2) as total,
           round(100.0 * sum(o_totalprice) / sum(sum(o_totalprice)) over (), 2) as pct_of_total
    from orders join customer on o_custkey = c_custkey group by c_mktsegment
    """,
)
def pct_of_total(t: Tables) -> DataFrame:
    """Orders are summed per customer first, so that no customer is a hot join key."""
    per_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("o_totalprice"))
    rows = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_totalprice")
    return R.share_of_total(rows, ["c_mktsegment"], "o_totalprice").withColumn("total", F.round("total", 2))


@query(
    "group_agg_topn",
    """
    select p_brand, round(avg(l_extendedprice), 4) as value from lineitem join part on l_partkey = p_partkey
    group by p_brand order by avg(l_extendedprice) desc, p_brand limit 15
    """,
)
def group_agg_topn(t: Tables) -> DataFrame:
    """Lines are summed per part before the join, so that no part is a hot key."""
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("total"), F.count("l_extendedprice").alias("n"))
    rows = per_part.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    means = rows.groupBy("p_brand").agg((F.sum("total") / F.sum("n")).alias("value"))
    return R.global_top_n(means, "value", 15, ["p_brand"]).withColumn("value", F.round("value", 4))


@query(
    "global_topn",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
)
def global_topn(t: Tables) -> DataFrame:
    return R.global_top_n(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("preview", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer order by c_custkey limit 10")
def preview(t: Tables) -> DataFrame:
    return R.preview(t.customer, ["c_custkey"], 10)


_SUMMARY_SQL = """
    with base as (select o_orderpriority, o_orderstatus, o_totalprice from orders where o_totalprice > {floor})
    select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total,
           round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high
    from base group by o_orderpriority, o_orderstatus having count(*) > 20
    order by o_orderpriority, o_orderstatus limit 100
"""


@query("sql_group_summary", _SUMMARY_SQL.format(floor=100000))
def sql_group_summary(t: Tables) -> DataFrame:
    registry = TableRegistry(t.spark)
    registry.replace("orders", t.orders)
    return registry.select(_SUMMARY_SQL.format(floor=":floor"), {"floor": 100000})


@query(
    "sql_params",
    "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice between 300000 and 310000",
)
def sql_params(t: Tables) -> DataFrame:
    registry = TableRegistry(t.spark)
    registry.replace("orders", t.orders)
    return registry.select(
        "select o_orderkey, o_totalprice from orders where o_orderstatus = :status and o_totalprice between :low and :high",
        {"status": "F", "low": 300000, "high": 310000},
    )


@query(
    "table_schema",
    """
    select cast(ordinal_position as bigint) as position, column_name as "column",
      case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
        when 'VARCHAR' then 'string' else 'timestamp_ntz' end as type, true as nullable
    from information_schema.columns where table_name = 'lineitem'
    """,
)
def schema_of_lineitem(t: Tables) -> DataFrame:
    return table_schema(t.lineitem)


_COUNTED = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]


@query(
    "row_counts",
    " union all ".join(f"select '{n}' as \"table\", count(*) as n_rows from {n}" for n in _COUNTED),
)
def counts_of_tables(t: Tables) -> DataFrame:
    return row_counts({n: getattr(t, n) for n in _COUNTED})


@query(
    "clean_names",
    """
    select 'order_key' as "column", count(o_orderkey) as n from orders
    union all select 'order_key_1', count(o_custkey) from orders
    union all select 'col_1st_status', count(o_orderstatus) from orders
    union all select 'total_price', count(o_totalprice) from orders
    union all select 'column', count(o_orderdate) from orders
    union all select 'order_priority', count(o_orderpriority) from orders
    """,
)
def clean_names(t: Tables) -> DataFrame:
    """Awkward headers over the orders table, cleaned and made unique, with the cells each column holds."""
    awkward = t.orders.toDF(" Order Key ", "order_key", "1st Status!", "Total  (Price)", "??", "Order__Priority")
    clean = clean_columns(awkward)
    return clean.agg(*[F.count(c).alias(c) for c in clean.columns]).unpivot([], clean.columns, "column", "n")


@query(
    "set_union_distinct",
    "select o_custkey as custkey from orders union select c_custkey from customer where c_acctbal > 0",
)
def set_union_distinct(t: Tables) -> DataFrame:
    ordering = t.orders.select(F.col("o_custkey").alias("custkey"))
    return ordering.union(t.customer.where("c_acctbal > 0").select("c_custkey")).distinct()


@query("set_except", "select c_custkey as custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def set_except(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    return t.customer.select(F.col("c_custkey").alias("custkey")).subtract(done)


@query(
    "value_intersect",
    "select cast(doc_id as varchar) as value from labels intersect select cast(vec_id as varchar) from embeddings",
)
def value_intersect(t: Tables) -> DataFrame:
    return R.value_intersect(t.labels, "doc_id", t.embeddings, "vec_id")


@query(
    "table_diff",
    f"""
    {MESSY_SQL}, l as (select order_id, priority, count(*) as n from messy group by all),
    r as (select o_orderkey as order_id, o_orderpriority as priority, count(*) as n from orders group by all)
    select coalesce(l.order_id, r.order_id) as order_id, case when l.n is null then r.priority else l.priority end as priority,
      coalesce(l.n, 0) as n_left, coalesce(r.n, 0) as n_right
    from l full join r on l.order_id = r.order_id and l.priority is not distinct from r.priority
    where coalesce(l.n, 0) <> coalesce(r.n, 0)
    """,
)
def table_diff(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))
    return table_differences(t.messy.select("order_id", "priority"), right)


@query(
    "table_identity",
    """
    select 'orders' as left_name, 'orders' as right_name,
      not exists (select * from orders except all select * from orders) as same_content
    union all select 'orders', 'orders_rounded', not exists (
      select * from orders except all
      select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 0), o_orderdate, o_orderpriority from orders)
    union all select 'orders', 'orders_reversed', not exists (
      select * from orders except all select * from (select * from orders order by o_orderkey desc))
    """,
)
def table_identity(t: Tables) -> DataFrame:
    """Whether tables of one name and schema hold the same rows, in whatever order."""
    orders = t.orders
    others = {
        "orders": orders,
        "orders_rounded": orders.withColumn("o_totalprice", F.round("o_totalprice", 0)),
        "orders_reversed": orders.orderBy(F.desc("o_orderkey")),
    }
    rows = [("orders", name, same_content(orders, other)) for name, other in others.items()]
    return t.spark.createDataFrame(rows, "left_name string, right_name string, same_content boolean")


def _key_tables(t: Tables) -> dict[str, DataFrame]:
    """The tables with the prefixes of their column names removed, so that keys share names."""
    return {
        "lineitem": t.lineitem.selectExpr(
            "l_orderkey as orderkey", "l_partkey as partkey", "cast(l_suppkey as double) as suppkey", "l_quantity as quantity"
        ),
        "orders": t.orders.selectExpr("o_orderkey as orderkey", "o_custkey as custkey"),
        "customer": t.customer.selectExpr("c_custkey as custkey", "c_nationkey as nationkey"),
        "part": t.part.selectExpr("p_partkey as partkey", "cast(p_size as double) as quantity"),
        "supplier": t.supplier.selectExpr("s_suppkey as suppkey", "s_nationkey as nationkey"),
    }


def _overlap_sql(lt: str, le: str, rt: str, re: str) -> str:
    """Shared distinct values over the smaller distinct set, keys compared as numbers."""
    a = f"select distinct cast({le} as double) as v from {lt} where {le} is not null"
    b = f"select distinct cast({re} as double) as v from {rt} where {re} is not null"
    return (
        f"(select count(*) * 1.0 / least((select count(*) from ({a})), (select count(*) from ({b}))) "
        f"from ({a} intersect {b}))"
    )


_PAIRS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey", "partkey"),
    ("lineitem", "l_quantity", "part", "p_size", "quantity"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey", "custkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey", "nationkey"),
]


@query(
    "join_keys",
    "select left_table, right_table, name as left_column, name as right_column, round(overlap, 3) as overlap, id_like from ("
    + " union all ".join(
        f"select '{lt}' as left_table, '{rt}' as right_table, '{name}' as name, {_overlap_sql(lt, le, rt, re)} as overlap, "
        f"{str('key' in name).lower()} as id_like"
        for lt, le, rt, re, name in _PAIRS
    )
    + ") where overlap >= 0.1 or id_like",
)
def join_keys(t: Tables) -> DataFrame:
    return discover_join_keys(t.spark, _key_tables(t), None).drop("same_name")


@query(
    "join_keys_similar",
    "select left_table, right_table, left_column, right_column, round(overlap, 3) as overlap from ("
    f"select 'lines' as left_table, 'parts' as right_table, 'part_key' as left_column, 'partkey' as right_column, "
    f"{_overlap_sql('lineitem', 'l_partkey', 'part', 'p_partkey')} as overlap union all "
    f"select 'lines', 'orders', 'orderkey', 'order_key', {_overlap_sql('lineitem', 'l_orderkey', 'orders', 'o_orderkey')})",
)
def join_keys_similar(t: Tables) -> DataFrame:
    tables = {
        "lines": t.lineitem.selectExpr("l_partkey as part_key", "l_orderkey as orderkey"),
        "parts": t.part.selectExpr("p_partkey as partkey"),
        "orders": t.orders.selectExpr("o_orderkey as order_key"),
    }
    return discover_join_keys(t.spark, tables, None).where("not same_name").drop("same_name", "id_like")


_KEY_COLUMNS = {
    "lineitem": ["orderkey bigint", "partkey bigint", "suppkey double", "quantity double"],
    "orders": ["orderkey bigint", "custkey bigint"],
    "customer": ["custkey bigint", "nationkey int"],
    "part": ["partkey bigint", "quantity double"],
    "supplier": ["suppkey bigint", "nationkey int"],
}


@query(
    "catalog_overview",
    " union all ".join(
        [f"select 'rows' as kind, '{n}' as \"table\", 'n_rows' as item, cast(count(*) as varchar) as detail from {n}" for n in _KEY_COLUMNS]
        + [f"select 'column', '{n}', '{c.split()[0]}', '{c.split()[1]}'" for n, columns in _KEY_COLUMNS.items() for c in columns]
    )
    + " union all select 'join', left_table, name, right_table || '.' || name from (select * from ("
    + " union all ".join(
        f"select {place} as place, '{lt}' as left_table, '{rt}' as right_table, '{name}' as name, "
        f"{_overlap_sql(lt, le, rt, re)} as overlap from (select 1)"
        for place, (lt, le, rt, re, name) in enumerate(_PAIRS)
    )
    + ") where overlap >= 0.1 or contains(name, 'key'))",
)
def overview(t: Tables) -> DataFrame:
    return catalog_overview(t.spark, _key_tables(t))


@query(
    "timeseries_mean",
    "select date_trunc('hour', ts) as hour, round(avg(value), 4) as value, count(*) as n_rows from events "
    "where value is not null group by 1",
)
def timeseries_mean(t: Tables) -> DataFrame:
    hourly = t.events.select(F.date_trunc("hour", "ts").alias("hour"), "value")
    return R.time_series_mean(hourly, "hour", "value").select(
        F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("value", 4).alias("value"), "n_rows"
    )


@query(
    "event_gaps",
    f"""
    select event_id, event_type, {sql_rounded("(epoch_us(ts) - epoch_us(p)) / 86400000000.0", 6)} as gap_days
    from (select *, lag(ts) over (partition by event_type order by ts, event_id) as p from events)
    """,
)
def event_gaps(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "event_type")
    gaps = R.event_gaps(rows, "ts", ["event_id"], ["event_type"])
    return gaps.select("event_id", "event_type", rounded("gap_days", 6).alias("gap_days"))


@query(
    "event_index",
    f"""
    select event_id, row_number() over (order by ts, event_id) as event_no,
      {sql_rounded("(epoch_us(ts) - epoch_us(min(ts) over ())) / 86400000000.0", 6)} as elapsed_days from events
    """,
)
def event_index(t: Tables) -> DataFrame:
    numbered = R.event_index(t.events.select("event_id", "ts"), "ts", ["event_id"])
    return numbered.select("event_id", "event_no", rounded("elapsed_days", 6).alias("elapsed_days"))


@query(
    "eq_or_contains_filter",
    f"""
    {MESSY_SQL}, a as (select * from messy where case
        when (select coalesce(bool_or(lower(priority) = 'urgent'), false) from messy)
        then lower(priority) = 'urgent' else contains(lower(priority), 'urgent') end)
    select order_id, priority, amount_text from a where case
        when (select coalesce(bool_or(lower(amount_text) = 'n/a'), false) from a)
        then lower(amount_text) = 'n/a' else contains(lower(amount_text), 'n/a') end
    """,
)
def eq_or_contains_filter(t: Tables) -> DataFrame:
    kept = R.equal_or_contains(t.messy, [("priority", "Urgent"), ("amount_text", "N/A")])
    return kept.select("order_id", "priority", "amount_text")


@query(
    "filter_notes",
    f"""
    {MESSY_SQL}, a as (select * from messy where contains(lower(priority), 'urgent')),
    b as (select * from a where lower(amount_text) = 'n/a')
    select cast(1 as bigint) as step, 'priority' as "column", 'Urgent' as value,
      (select count(*) from messy) as rows_before, (select count(*) from a) as rows_after
    union all select 2, 'amount_text', 'N/A', (select count(*) from a), (select count(*) from b)
    """,
)
def filter_notes(t: Tables) -> DataFrame:
    return R.filter_notes(t.messy, [("priority", "Urgent"), ("amount_text", "N/A")])


@query(
    "factorize",
    f"""
    {MESSY_SQL}, f as (select priority, min(order_id) as first_id from messy where priority is not null group by priority),
    c as (select priority, row_number() over (order by first_id, priority) - 1 as code from f)
    select order_id, m.priority, coalesce(code, -1) as code from messy m left join c on m.priority = c.priority
    """,
)
def factorize(t: Tables) -> DataFrame:
    return R.factorize(t.messy.select("order_id", "priority"), "priority", ["order_id"], "code")


@query(
    "drop_duplicates",
    f"{MESSY_SQL} select distinct * from messy",
)
def drop_duplicates(t: Tables) -> DataFrame:
    return t.messy.dropDuplicates()
