"""The exploratory profile as one long table, from three scans of the data.

Each row is (section, column, key, n, value). The first scan is one aggregate
with everything that has one row per column or pair; the second counts the
values of categories, exactly, which also tells the groupings; the third makes
histograms, group means and means per day in one aggregate over long rows, so
that no section has a job or a scan of its own.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import as_double, categorical_columns, numeric_columns, quoted, rows_from_wide, text_columns, time_columns
from sextant.functions.dates import parse_mixed_date
from sextant.operators.frequencies import value_frequencies
from sextant.operators.roles import KPI_NAME_PARTS
from sextant.scratch import materialize

SCHEMA = "section string, column string, key string, n bigint, value double"
BINS = 30
TOP_VALUES = 15
MOST_LEVELS = 30
GROUPINGS = 3
#: Share of all rows that must read as dates in a text column.
DATE_SHARE = 0.8


def eda_sections(df: DataFrame) -> DataFrame:
    """Missing cells, description, correlation, value counts, histograms, group means and daily means.

    Infinite numbers have no bin. Days come from the first date column, or else
    the first text column that reads as dates, which then is no category.
    """
    spark = df.sparkSession
    numbers, texts, times = numeric_columns(df), text_columns(df), time_columns(df)
    # First scan: a row as wide as the schema, and its few facts on the driver.
    number = {c: as_double(df, c) for c in numbers}
    finite = {c: F.when(F.abs(v) < F.lit(float("inf")), v) for c, v in number.items()}
    aggs = {"rows": F.count("*")}
    for i, c in enumerate(df.columns):
        aggs[f"c{i}"] = F.count(number.get(c, quoted(c)))
        if c in texts:
            aggs[f"d{i}"] = F.count(parse_mixed_date(quoted(c)))
    for i, c in enumerate(numbers):
        aggs |= {
            f"mean{i}": F.avg(number[c]), f"std{i}": F.stddev_samp(number[c]), f"min{i}": F.min(number[c]),
            f"max{i}": F.max(number[c]), f"low{i}": F.min(finite[c]), f"high{i}": F.max(finite[c]),
        }
    for i, j in combinations(range(len(numbers)), 2):
        both = number[numbers[i]].isNotNull() & number[numbers[j]].isNotNull()
        aggs[f"r{i}_{j}"] = F.corr(F.when(both, number[numbers[i]]), F.when(both, number[numbers[j]]))
    wide = materialize(df.agg(*[a.alias(n) for n, a in aggs.items()]), "eda-facts")
    facts = wide.first()

    def row(section: str, column: str, key: str | None, n, value):
        value = value if value is not None else F.lit(None)
        return [F.lit(section).alias("section"), F.lit(column).alias("column"), F.lit(key).cast("string").alias("key"),
                n.cast("bigint").alias("n"), value.cast("double").alias("value")]

    records = []
    for i, c in enumerate(df.columns):
        missing = F.col("rows") - F.col(f"c{i}")
        records.append(row("missing", c, None, missing, F.try_divide(missing * 100.0, F.col("rows"))))
        if c in numbers:
            k = numbers.index(c)
            records += [row("describe", c, stat, F.col(f"c{i}"), F.col(f"{stat}{k}")) for stat in ("mean", "std", "min", "max")]
    for i, j in combinations(range(len(numbers)), 2):
        records.append(row("correlation", numbers[i], numbers[j], F.col("rows"), F.col(f"r{i}_{j}")))
    found = rows_from_wide(wide, records)

    dated = [c for i, c in enumerate(df.columns) if c in texts and facts["rows"] and facts[f"d{i}"] >= DATE_SHARE * facts["rows"]]
    day = (times or dated or [None])[0]
    categories = [c for c in categorical_columns(df) if c not in dated]
    groupings: list[tuple[str, str]] = []
    if categories:  # second scan
        counted = materialize(value_frequencies(df, categories), "eda-values")
        order = W.partitionBy("column").orderBy(F.desc("n"), "value")
        top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP_VALUES)
        found = found.unionByName(
            top.select(F.lit("value_counts").alias("section"), "column", F.col("value").alias("key"), "n", F.lit(None).cast("double").alias("value"))
        )
        levels = {r["column"]: r["k"] for r in counted.groupBy("column").agg(F.count("*").alias("k")).collect()}
        usable = sorted((c for c in categories if 2 <= levels.get(c, 0) <= MOST_LEVELS), key=lambda c: (levels[c], df.columns.index(c)))
        metrics = sorted(numbers, key=lambda c: (not any(p in c.lower() for p in KPI_NAME_PARTS), df.columns.index(c)))
        groupings = [(c, m) for c in usable for m in metrics][:GROUPINGS]

    def cell(section: str, column: str, key, value):
        return F.struct(F.lit(section).alias("section"), F.lit(column).alias("column"), key.cast("string").alias("key"), value.alias("value"))

    cells = []
    for i, c in enumerate(numbers):
        low, high = facts[f"low{i}"], facts[f"high{i}"]
        if low is not None:
            width = (high - low) / BINS
            place = F.least(F.floor((finite[c] - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
            cells.append(F.when(finite[c].isNotNull(), cell("histogram", c, place, number[c])))
    cells += [cell("group_mean", f"{m} by {g}", quoted(g), number[m]) for g, m in groupings]
    if day is not None:
        stamp = quoted(day) if day in times else parse_mixed_date(quoted(day))
        date = F.date_format(stamp, "yyyy-MM-dd")
        cells += [F.when(stamp.isNotNull() & number[c].isNotNull(), cell("daily_mean", f"{c} by {day}", date, number[c])) for c in numbers]
    if cells:  # third scan; partial sums leave the tasks
        long = df.select(F.explode(F.array(*cells)).alias("c")).where("c is not null").select("c.*")
        sums = long.groupBy("section", "column", "key").agg(F.count("value").alias("n"), F.avg("value").alias("value"))
        plain = F.when(F.col("section") != "histogram", F.col("value"))
        found = found.unionByName(sums.select("section", "column", "key", "n", plain.alias("value")))
    return found.select("section", "column", "key", "n", "value") if records else spark.createDataFrame([], SCHEMA)
