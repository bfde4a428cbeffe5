"""Join-key discovery by name and measured value overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.columns import as_double, quoted

# Name parts that mark a key column.
KEY_NAME_PARTS = ["id", "key", "code", "sku", "uuid"]
MIN_OVERLAP = 0.1
BITS = 62
SCHEMA = (
    "left_table string, right_table string, left_column string, right_column string, "
    "overlap double, id_like boolean, same_name boolean"
)


def key_text(df: DataFrame, name: str) -> Column:
    """Cell as text such that 1 and 1.0 are the same key."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = as_double(df, name)
        whole = (value == F.floor(value)) & (F.abs(value) < 9e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return quoted(name).cast("string")


def discover_join_keys(spark: SparkSession, tables: dict[str, DataFrame], max_pairs: int | None = None) -> DataFrame:
    """Column pairs of different tables that may join.

    Equal names count if at least a tenth of the smaller value set is shared or
    the name looks like a key; names equal but for underscores always count.
    Every candidate column is read in full. The shuffle carries distinct
    values only: a value's row holds one bit per table column it occurs in.
    """
    members: dict[str, list[tuple[str, str]]] = {}
    for table, df in tables.items():
        for c in df.columns:
            members.setdefault(c.replace("_", ""), []).append((table, c))
    members = {name: cols for name, cols in members.items() if len({t for t, _ in cols}) > 1}
    place = {t: i for i, t in enumerate(tables)}
    pairs = []
    for name, cols in members.items():
        for i, (lt, lc) in enumerate(cols):
            for j in range(i + 1, len(cols)):
                rt, rc = cols[j]
                if lt != rt:
                    pairs.append((name, i, j, lt, rt, lc, rc, place[lt], place[rt]))
    if not pairs:
        return spark.createDataFrame([], SCHEMA)

    words = 1 + max(len(cols) for cols in members.values()) // BITS
    parts = []
    for table, df in tables.items():
        cells = []
        for name, cols in members.items():
            for i, (t, c) in enumerate(cols):
                if t == table:
                    masks = [
                        F.lit(1 << (i % BITS) if i // BITS == w else 0).cast("bigint").alias(f"m{w}")
                        for w in range(words)
                    ]
                    cells.append(F.struct(F.lit(name).alias("name"), key_text(df, c).alias("value"), *masks))
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).where("value is not null"))
    masks = [f"m{w}" for w in range(words)]
    values = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("name", "value")
        .agg(*[F.bit_or(m).alias(m) for m in masks])
        .groupBy("name", *masks)
        .agg(F.count("*").alias("n"))
    )
    wanted = spark.createDataFrame(
        pairs,
        "name string, i int, j int, left_table string, right_table string, left_column string, "
        "right_column string, li int, ri int",
    )
    word = F.array(*[F.col(m) for m in masks])

    def holds(bit: str) -> Column:
        at = F.get(word, F.floor(F.col(bit) / BITS).cast("int"))
        return at.bitwiseAND(F.expr(f"shiftleft(1L, cast({bit} % {BITS} as int))")) != 0

    # The pair list has one row per pair of columns, whatever the tables hold.
    counted = (
        values.join(F.broadcast(wanted), "name")
        .groupBy("left_table", "right_table", "left_column", "right_column", "li", "ri")
        .agg(
            F.sum(F.when(holds("i"), F.col("n")).otherwise(0)).alias("n_left"),
            F.sum(F.when(holds("j"), F.col("n")).otherwise(0)).alias("n_right"),
            F.sum(F.when(holds("i") & holds("j"), F.col("n")).otherwise(0)).alias("n_both"),
        )
    )
    low = F.lower("left_column")
    same = F.col("left_column") == F.col("right_column")
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in KEY_NAME_PARTS]) | ~same
    smaller = F.least("n_left", "n_right")
    overlap = F.try_divide(F.col("n_both"), smaller)
    found = (
        counted.where((smaller > 0) & ((overlap >= MIN_OVERLAP) | named))
        .withColumn("overlap", F.round(overlap, 3))
        .withColumn("id_like", named)
        .withColumn("same_name", same)
        .orderBy("li", "ri", F.desc("same_name"), "left_column", "right_column")
    )
    if max_pairs is not None:
        found = found.limit(max_pairs)
    return found.select(
        "left_table", "right_table", "left_column", "right_column", "overlap", "id_like", "same_name"
    )
