"""Group comparison and correlation with significance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.columns import as_double, empty_like, is_numeric, numeric_columns, quoted
from sextant.functions.tails import f_tail, t_tail
from sextant.operators.frequencies import cardinalities
from sextant.operators.profile import pairwise_correlation
from sextant.operators.relational import factorize

ALPHA = 0.05
SMALL_SAMPLE = 30


def verdict(p_value: Column) -> Column:
    """True or false at alpha = .05; null when the p-value is undefined."""
    return F.when(p_value.isNotNull(), p_value < ALPHA)


def group_moments(df: DataFrame, group: str, metric: str, min_rows: int = 2) -> DataFrame:
    """(grp, n, mean, var) of the groups with enough numeric cells."""
    value = as_double(df, metric)
    return (
        df.where(quoted(group).isNotNull() & value.isNotNull())
        .groupBy(quoted(group).cast("string").alias("grp"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
        .where(F.col("n") >= min_rows)
    )


def welch_t(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Welch's t-test of exactly two groups in ascending order; no row for any other number of groups."""
    side = F.struct("grp", "n", "mean", "var")
    two = (
        group_moments(df, group, metric)
        .agg(F.count("*").alias("k"), F.min_by(side, "grp").alias("a"), F.max_by(side, "grp").alias("b"))
        .where("k = 2")
    )
    share_a, share_b = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    spread = share_a + share_b
    dof = F.try_divide(
        spread * spread,
        share_a * share_a / (F.col("a.n") - 1) + share_b * share_b / (F.col("b.n") - 1),
    )
    tested = two.select(
        F.col("a.grp").alias("group_a"),
        F.col("b.grp").alias("group_b"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
        F.col("a.mean").alias("mean_a"),
        F.col("b.mean").alias("mean_b"),
        F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(spread)).alias("t"),
        dof.alias("dof"),
    )
    return _with_p(tested, t_tail("t", "dof"), F.col("n_a") + F.col("n_b"))


def anova_f(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One-way analysis of variance over three or more groups; F is null without spread inside groups."""
    moments = group_moments(df, group, metric)
    grand = moments.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    sums = moments.agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_total"),
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, F.lit(2.0))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
    ).where("n_groups >= 3")
    tested = (
        sums.withColumn("df1", F.col("n_groups") - 1)
        .withColumn("df2", F.col("n_total") - F.col("n_groups"))
        .withColumn("f", F.try_divide(F.col("ssb") / F.col("df1"), F.col("ssw") / F.col("df2")))
    )
    return _with_p(tested, f_tail("f", F.col("df1").cast("double"), F.col("df2").cast("double")), F.col("n_total"))


def _with_p(tested: DataFrame, p_value: Column, n: Column) -> DataFrame:
    return (
        tested.withColumn("p_value", p_value)
        .withColumn("significant", verdict(F.col("p_value")))
        .withColumn("small_sample", n < SMALL_SAMPLE)
    )


def compare_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One row whichever test applies: Welch for two groups, ANOVA for more, none for fewer."""
    schema = ["test", "n_groups", "n_total", "statistic", "dof1", "dof2", "p_value", "significant", "small_sample"]
    welch = welch_t(df, group, metric).select(
        F.lit("welch_t").alias("test"),
        F.lit(2).cast("bigint").alias("n_groups"),
        (F.col("n_a") + F.col("n_b")).alias("n_total"),
        F.col("t").alias("statistic"),
        F.col("dof").alias("dof1"),
        F.lit(None).cast("double").alias("dof2"),
        "p_value",
        "significant",
        "small_sample",
    )
    anova = anova_f(df, group, metric).select(
        F.lit("anova_f").alias("test"),
        "n_groups",
        "n_total",
        F.col("f").alias("statistic"),
        F.col("df1").cast("double").alias("dof1"),
        F.col("df2").cast("double").alias("dof2"),
        "p_value",
        "significant",
        "small_sample",
    )
    return welch.select(*schema).unionByName(anova.select(*schema))


# Name parts that mark a default correlation target, in order of preference.
TARGET_NAME_PARTS = ["churn", "price", "revenue", "sales", "target", "label"]
RANKING_SCHEMA = (
    "column string, n bigint, r double, strength string, direction string, p_value double, significant boolean"
)


def default_target(df: DataFrame) -> str | None:
    for part in TARGET_NAME_PARTS:
        for c in df.columns:
            if part in c.lower():
                return c
    numbers = numeric_columns(df)
    return numbers[-1] if numbers else None


def corr_ranking(
    df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Numeric columns by absolute correlation with the target.

    A text target with at most 10 labels is coded by first appearance (in
    ``order_by``, else by value). Features that are constant or overlap in
    fewer than 3 rows are left out; a constant target is an error.
    """
    target = target or default_target(df)
    numbers = numeric_columns(df)
    features = [c for c in (features or numbers) if c != target]
    work, y = df, target
    if not is_numeric(df, target):
        levels = cardinalities(df, [target])[target]
        if levels > 10:
            raise ValueError(f"target {target!r} has {levels} labels; at most 10 can be coded")
        work, y = factorize(df, target, list(order_by) or [target], "_target"), "_target"
    extent = work.agg(F.min(as_double(work, y)).alias("low"), F.max(as_double(work, y)).alias("high")).first()
    if extent["low"] == extent["high"]:
        raise ValueError(f"target {target!r} has no variance; correlation is undefined")
    if not features:
        return empty_like(df, RANKING_SCHEMA)
    rows = (
        pairwise_correlation(work, [(c, y) for c in features])
        .where("n >= 3 and r is not null")
        .select(F.col("col_a").alias("column"), "n", "r")
    )
    size = F.abs("r")
    labelled = rows.withColumn(
        "strength", F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak")
    ).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    dof = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(dof, F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r"))))
    tested = labelled.withColumn("_t", t).withColumn("_dof", dof)
    p = F.when(F.col("_t").isNull(), F.lit(0.0)).otherwise(t_tail("_t", "_dof"))
    return (
        tested.withColumn("p_value", p)
        .withColumn("significant", verdict(F.col("p_value")))
        .drop("_t", "_dof")
        .orderBy(F.desc(F.abs("r")), "column")
    )
