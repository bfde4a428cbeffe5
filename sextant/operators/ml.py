"""Feature preparation, model leaderboards, clustering and importances on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sextant.columns import (
    as_double,
    categorical_columns,
    numeric_columns,
    quoted,
    text_columns,
    time_columns,
)
from sextant.functions.dates import date_parts, parse_mixed_date
from sextant.operators import roles
from sextant.operators.frequencies import cardinalities, columns_within, distinct_reaches, value_counts_topk
from sextant.operators.joins import join_on_keys, small_side
from sextant.operators.ordering import ONE_TASK_ROWS, number_rows
from sextant.operators.profile import infer_types
from sextant.operators.quantiles import column_quantiles
from sextant.scratch import materialize

HIGH_CARDINALITY = 40
MAX_CATEGORIES = 20
MISSING = "missing"
POOLED = "infrequent"
SEED = 42
#: Encoded rows of one task while models are fitted. Each level of each tree is a job, so that small tasks cost most.
FIT_TASK_ROWS = 25_000


# -- preparation ------------------------------------------------------------


@dataclass
class Features:
    """Prepared rows with the roles of their columns and what was left out."""

    data: DataFrame
    numeric: list[str]
    categorical: list[str]
    target: str | None
    keep: list[str]
    dropped: list[str] = field(default_factory=list)


def with_date_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace date columns by month, weekday and year."""
    times = time_columns(df)
    kept = [quoted(c) for c in df.columns if c not in columns]
    parts: list[Column] = []
    for c in columns:
        stamp = quoted(c) if c in times else parse_mixed_date(quoted(c))
        parts += date_parts(stamp, c)
    return df.select(*kept, *parts)


def prepare_features(
    df: DataFrame, target: str | None = None, exclude: Sequence[str] = (), keep: Sequence[str] = ()
) -> Features:
    """Drop identifiers and high-cardinality text, expand dates, fill gaps.

    ``keep`` names columns carried along without being features, such as a row
    key. All decisions rest on schema-sized statistics; the rows stay one lazy plan.
    """
    candidates = [c for c in df.columns if c not in (target, *keep)]
    named = [c for c in candidates if c.lower().endswith("_id")]
    limit = max(20, df.count() // 2) if named else 0
    unique = distinct_reaches(df, {c: limit + 1 for c in named})
    dropped = [
        c for c in candidates
        if c in exclude or c.lower() in ("id", "index") or unique.get(c, False)
    ]
    work = df.drop(*dropped)
    others = [quoted(c) for c in (target, *keep) if c]
    features = [c for c in candidates if c not in dropped]
    dates = [c for c in features if c in time_columns(df)]
    texts = [c for c in features if c in text_columns(df)]
    if texts:
        typed = infer_types(work.select(*[quoted(c) for c in texts])).where("inferred = 'timestamp'")
        dates += [r["column"] for r in typed.collect()]  # one row per column
    work = with_date_parts(work, dates)
    texts = [c for c in texts if c not in dates]
    possible = columns_within(work, texts, HIGH_CARDINALITY)
    levels = cardinalities(work, possible)
    high = [c for c in texts if levels.get(c, HIGH_CARDINALITY + 1) > HIGH_CARDINALITY]
    work = work.drop(*high)

    reserved = {c for c in (target, *keep) if c}
    numeric = [c for c in numeric_columns(work) if c not in reserved]
    categorical = [c for c in categorical_columns(work) if c not in reserved]
    medians = column_quantiles(work, numeric, (0.5,))
    filled = [
        F.coalesce(as_double(work, c), F.lit(medians[c].values[0]), F.lit(0.0)).alias(c) for c in numeric
    ] + [F.coalesce(quoted(c).cast("string"), F.lit(MISSING)).alias(c) for c in categorical]
    return Features(work.select(*others, *filled), numeric, categorical, target, list(keep), dropped + high)


def pool_rare(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Keep the most frequent labels of each column and pool the rest into one."""
    if not columns:
        return df
    levels = cardinalities(df, columns)
    wide = [c for c in columns if levels[c] > max_categories]
    if not wide:
        return df
    top: dict[str, list[str]] = {c: [] for c in wide}
    for r in value_counts_topk(df, wide, max_categories - 1).collect():  # a few labels per column
        top[r["column"]].append(r["value"])
    return df.select(
        *[
            F.when(quoted(c).isin(top[c]), quoted(c)).otherwise(F.lit(POOLED)).alias(c) if c in wide else quoted(c)
            for c in df.columns
        ]
    )


def encoder(features: Features, output: str = "features") -> Pipeline:
    """Standardise numerics and one-hot categories; labels unseen in training become all zeros."""
    stages, parts = [], []
    if features.numeric:
        stages += [
            VectorAssembler(inputCols=features.numeric, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if features.categorical:
        index = [f"_i_{c}" for c in features.categorical]
        hot = [f"_h_{c}" for c in features.categorical]
        stages += [
            StringIndexer(
                inputCols=features.categorical, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="keep"),
        ]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages)


def encoded_features(features: Features) -> DataFrame:
    """Kept columns and the encoded vector as an array of doubles."""
    pooled = pool_rare(features.data, features.categorical)
    rows = encoder(features).fit(pooled).transform(pooled)
    return rows.select(*[quoted(c) for c in features.keep], vector_to_array("features").alias("features"))


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns standardised by mean and population deviation (0 where a column is constant)."""
    stats = df.agg(
        F.struct(
            *[F.avg(as_double(df, c)).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(as_double(df, c)).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    scaled = {
        c: F.coalesce(F.try_divide(as_double(df, c) - stats[f"m_{c}"], stats[f"s_{c}"]), as_double(df, c) * 0.0).alias(c)
        for c in columns
    }
    return df.select(*[scaled.get(c, quoted(c)) for c in df.columns])


# -- split ------------------------------------------------------------------


def stratified_split(
    df: DataFrame, label: str | None, key: Sequence[str], train_share: float = 0.8, seed: int = SEED,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add ``split``: train, or test for the last rows of each class in the order of a hash of the key.

    One rule at every size: exactly the test share of a class, rounded up, is
    held out; a class of one row stays in training. Without a label all rows
    are one class. A class too large for one task is numbered slice by slice.
    """
    work = df.withColumn("_ticket", split_ticket(key, seed))
    keys = ["_stratum"] if label is not None else []
    if keys:
        work = work.withColumn("_stratum", quoted(label))
    numbered = number_rows(work, ["_ticket", *key], keys, "_no", one_task_rows)
    if keys:
        sizes = materialize(df.groupBy(quoted(label).alias("_stratum")).agg(F.count("*").alias("_size")), "classes")
        numbered = join_on_keys(numbered, small_side(sizes), keys)
    else:
        numbered = numbered.withColumn("_size", F.lit(df.count()))
    n_test = F.ceil((1 - train_share) * F.col("_size") - 1e-9)
    held = (F.col("_no") > F.col("_size") - n_test) & (F.col("_size") >= 2)
    return numbered.withColumn("split", F.when(held, "test").otherwise("train")).drop("_ticket", "_stratum", "_no", "_size")


def split_ticket(key: Sequence[str], seed: int = SEED) -> Column:
    """Hash that orders rows for the split: MD5 of the key cells and the seed as text."""
    cells = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", *cells, F.lit(str(seed))).cast("binary"))


# -- models -----------------------------------------------------------------


class Trained(NamedTuple):
    leaderboard: DataFrame
    importances: DataFrame
    best_name: str
    best_model: object
    encoder: PipelineModel
    flags: list[str]


LEADERBOARD_CLASSIFICATION = "rank bigint, model string, accuracy double, f1 double"
LEADERBOARD_REGRESSION = "rank bigint, model string, rmse double, r2 double"
IMPORTANCE_SCHEMA = "rank bigint, feature string, importance double"


def _grid(task: str, n_train: int, n_classes: int) -> list[tuple[str, str, object]]:
    """(family, name, estimator): penalised linear models, forests and boosted trees on small grids."""
    common = {"featuresCol": "features", "labelCol": "_y"}
    models: list[tuple[str, str, object]] = []
    trees = [(n, d) for d in (3, 6) for n in (50, 100)]
    boosts = [(n, d) for d in (3, 4) for n in (50, 100)]
    if task == "classification":
        for c in (0.5, 2.0):
            # Penalty per row, as the loss is a mean here.
            models.append(
                ("linear", f"LogisticRegression(C={c})",
                 LogisticRegression(maxIter=400, regParam=1.0 / (c * n_train), standardization=False, **common))
            )
        for n, d in trees:
            models.append(("forest", f"RandomForest(n={n}, depth={d})",
                           RandomForestClassifier(numTrees=n, maxDepth=d, seed=SEED, **common)))
        for n, d in boosts:
            boost = GBTClassifier(maxIter=n, maxDepth=d, stepSize=0.1, seed=SEED, **common)
            if n_classes > 2:
                boost = OneVsRest(classifier=boost, **common)
            models.append(("boosting", f"GradientBoosting(n={n}, depth={d})", boost))
        return models
    for alpha in (0.5, 2.0):
        models.append(("linear", f"Ridge(alpha={alpha})",
                       LinearRegression(regParam=alpha / n_train, elasticNetParam=0.0, standardization=False, **common)))
    for n, d in trees:
        models.append(("forest", f"RandomForest(n={n}, depth={d})",
                       RandomForestRegressor(numTrees=n, maxDepth=d, seed=SEED, **common)))
    for n, d in boosts:
        models.append(("boosting", f"GradientBoosting(n={n}, depth={d})",
                       GBTRegressor(maxIter=n, maxDepth=d, stepSize=0.1, seed=SEED, **common)))
    return models


def _classification_metrics(predicted: DataFrame) -> dict[str, float]:
    """Accuracy and support-weighted F1 from the confusion counts: one small job."""
    cells = predicted.groupBy("_y", "prediction").agg(F.count("*").alias("n")).collect()  # classes squared
    total = sum(r["n"] for r in cells)
    hit, support, claimed = {}, {}, {}
    for r in cells:
        support[r["_y"]] = support.get(r["_y"], 0) + r["n"]
        claimed[r["prediction"]] = claimed.get(r["prediction"], 0) + r["n"]
        if r["_y"] == r["prediction"]:
            hit[r["_y"]] = r["n"]
    f1 = sum(n * 2 * hit.get(c, 0) / (n + claimed.get(c, 0)) for c, n in support.items())
    return {"accuracy": sum(hit.values()) / total, "f1": f1 / total} if total else {"accuracy": 0.0, "f1": 0.0}


def _regression_metrics(predicted: DataFrame) -> dict[str, float]:
    error = F.col("_y") - F.col("prediction")
    row = predicted.agg(
        F.avg(error * error).alias("mse"), F.var_pop("_y").alias("var"), F.count("*").alias("n")
    ).first()
    if not row["n"]:
        return {"rmse": 0.0, "r2": 0.0}
    r2 = 1.0 - row["mse"] / row["var"] if row["var"] else 0.0
    return {"rmse": math.sqrt(row["mse"]), "r2": r2}


FAMILIES = ("linear", "forest", "boosting")


def train_models(
    features: Features, task: str, key: Sequence[str], families: Sequence[str] = FAMILIES, parallelism: int = 4
) -> Trained:
    """Fit every candidate on the training rows and rank them on the held-out rows.

    The encoder is fitted on training rows only. The split is stored, as it is
    read several times. Encoded rows are dealt out by key, in key order, and
    cached once for all candidates; they may spill to disk. What a model learns
    then depends on the rows, not on how their files were cut. Candidates are
    fitted a few at a time, as in Spark's own tuning, so that short stages of one
    overlap another. A boosted model of few rounds is the start of the one of
    more rounds and is not fitted for itself unless it wins.
    """
    spark = features.data.sparkSession
    data = pool_rare(features.data, features.categorical).where(quoted(features.target).isNotNull())
    if task == "classification":
        data = data.withColumn("_label", quoted(features.target).cast("string"))
        split = stratified_split(data, "_label", key)
    else:
        data = data.withColumn("_y", as_double(data, features.target)).where("_y is not null")
        split = stratified_split(data, None, key)
    split = materialize(split, "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    stages = encoder(features)
    n_classes = 0
    if task == "classification":
        labels = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
        stages = Pipeline(stages=[*stages.getStages(), labels])
    fitted = stages.fit(train)
    if task == "classification":
        n_classes = len(fitted.stages[-1].labels)
    n_train, n_test = train.count(), test.count()
    encoded = [
        fitted.transform(_dealt(part, key, n)).select("features", "_y").persist(StorageLevel.MEMORY_AND_DISK)
        for part, n in ((train, n_train), (test, n_test))
    ]
    try:
        measure = _classification_metrics if task == "classification" else _regression_metrics

        def fit(group: list[tuple[str, str, object]]) -> list[tuple[str, object, object, dict[str, float]]]:
            *starts, (_, name, estimator) = group
            model = estimator.fit(encoded[0])
            found = [
                (n, e, None, measure(_predicted_by_first(model, e.getMaxIter(), encoded[1], task))) for _, n, e in starts
            ]
            return [*found, (name, estimator, model, measure(model.transform(encoded[1])))]

        groups = _one_fit_each([c for c in _grid(task, n_train, n_classes) if c[0] in families])
        with ThreadPoolExecutor(parallelism) as pool:
            # The slowest candidates come last in the grid and are started first.
            fits = list(pool.map(inheritable_thread_target(spark)(fit), reversed(groups)))[::-1]
        results = [r for group in fits for r in group]
        if task == "classification":
            results.sort(key=lambda r: -r[-1]["f1"])
        else:
            results.sort(key=lambda r: (-r[-1]["r2"], r[-1]["rmse"]))
        best_name, estimator, best_model, best = results[0]
        best_model = best_model or estimator.fit(encoded[0])
        names = _feature_names(encoded[0], features.numeric)
    finally:
        for part in encoded:
            part.unpersist()
    if task == "classification":
        schema, columns = LEADERBOARD_CLASSIFICATION, ("accuracy", "f1")
    else:
        schema, columns = LEADERBOARD_REGRESSION, ("rmse", "r2")
    board = [(i + 1, name, *[m[c] for c in columns]) for i, (name, _, _, m) in enumerate(results)]
    ranked = sorted(zip(names, _importances(best_model, len(names))), key=lambda x: (-x[1], x[0]))
    importance = [(i + 1, f, float(v)) for i, (f, v) in enumerate(ranked)]
    return Trained(
        spark.createDataFrame(board, schema),
        spark.createDataFrame(importance, IMPORTANCE_SCHEMA),
        best_name,
        best_model,
        fitted,
        risk_flags(n_train + n_test, len(names), task, best),
    )


def _dealt(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Rows dealt out by a hash of their key, to tasks whose number depends on theirs alone, each in key order."""
    tasks = max(1, math.ceil(n / FIT_TASK_ROWS))
    keys = [quoted(c) for c in key]
    return rows.repartition(tasks, *keys).coalesce(tasks).sortWithinPartitions(*keys)


def _one_fit_each(grid: list[tuple[str, str, object]]) -> list[list[tuple[str, str, object]]]:
    """Candidates of the grid, those together that differ in the rounds of boosting only, fewest first."""
    groups: dict[object, list] = {}
    for c in grid:
        boosted = isinstance(c[2], (GBTClassifier, GBTRegressor))
        groups.setdefault(c[2].getMaxDepth() if boosted else c[1], []).append(c)
    return [sorted(g, key=lambda c: c[2].getMaxIter()) if len(g) > 1 else g for g in groups.values()]


def _predicted_by_first(model: object, n: int, rows: DataFrame, task: str) -> DataFrame:
    """Rows with the prediction of the first trees: each round adds a tree and changes none before it."""
    margin = F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(model.trees[:n], model.treeWeights[:n])):
        rows = tree.setPredictionCol(f"_tree{i}").transform(rows)
        margin = margin + F.lit(weight) * F.col(f"_tree{i}")
    return rows.withColumn("prediction", (margin > 0).cast("double") if task == "classification" else margin)


def _feature_names(encoded: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Names of the vector's slots: numeric columns by name, categories as column_label."""
    groups = encoded.schema["features"].metadata["ml_attr"]["attrs"].values()
    slots = sorted((a for group in groups for a in group), key=lambda a: a["idx"])
    return [
        numeric[slot["idx"]] if slot["idx"] < len(numeric) else slot["name"].removeprefix("_h_") for slot in slots
    ]


def _importances(model: object, size: int) -> list[float]:
    if hasattr(model, "featureImportances"):
        return list(model.featureImportances.toArray())
    if hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        return list(abs(matrix[0])) if matrix.shape[0] == 1 else [0.0] * size
    if hasattr(model, "coefficients"):
        return list(abs(model.coefficients.toArray()))
    return [0.0] * size


def risk_flags(n_rows: int, n_features: int, task: str, metrics: dict[str, float]) -> list[str]:
    """Reasons to distrust a result."""
    score = metrics.get("accuracy" if task == "classification" else "r2", 0.0)
    tests = {
        "small_data": n_rows < 50,
        "suspiciously_high": score >= 0.98 and n_rows < 200,
        "near_perfect": task == "classification" and score >= 0.999,
        "more_features_than_rows": n_features > n_rows,
    }
    return [name for name, hit in tests.items() if hit]


# -- clustering -------------------------------------------------------------


def cluster_number(n_rows: int) -> int:
    wanted = min(5, max(2, int(math.sqrt(n_rows))))
    return min(wanted, max(2, n_rows // 5))


def _encoded_for_clustering(features: Features) -> DataFrame:
    pooled = pool_rare(features.data, features.categorical)
    return encoder(features).fit(pooled).transform(pooled)


def kmeans_clusters(features: Features, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their cluster, one row per cluster with size, share and overall silhouette)."""
    rows = _encoded_for_clustering(features).select(*[quoted(c) for c in features.keep], "features")
    # Stored and not cached here: the fit keeps its own decoded vectors, unless it is given a cached frame.
    rows = materialize(rows, "encoded")
    n = rows.count()
    model = KMeans(k=k or cluster_number(n), seed=SEED, featuresCol="features", predictionCol="cluster").fit(rows)
    assigned = model.transform(rows)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(assigned)
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n_rows")).collect()  # k rows
    summary = rows.sparkSession.createDataFrame(
        [(r["cluster"], r["n_rows"], r["n_rows"] / n, silhouette) for r in sizes],
        "cluster int, n_rows bigint, share double, silhouette double",
    )
    return assigned.drop("features"), summary


def pca_2d(features: Features) -> DataFrame:
    """Two principal coordinates per row."""
    rows = _encoded_for_clustering(features)
    model = PCA(k=2, inputCol="features", outputCol="_pca").fit(rows)
    xy = vector_to_array("_pca")
    return model.transform(rows).select(*[quoted(c) for c in features.keep], xy[0].alias("pc1"), xy[1].alias("pc2"))


# -- everything at once -----------------------------------------------------


class AutoMl(NamedTuple):
    task: str
    target: str | None
    leaderboard: DataFrame
    importances: DataFrame | None
    flags: list[str]


def automl(
    df: DataFrame, key: Sequence[str], target: str | None = None, task: str | None = None, exclude: Sequence[str] = ()
) -> AutoMl:
    """Pick target and task if not given, prepare, train and rank. ``key`` identifies a row."""
    if len(df.take(5)) < 5:
        raise ValueError("at least 5 rows are needed")
    target = target or (None if task == "clustering" else roles.default_target(df.drop(*key)))
    task = task or roles.task_type(df, target)
    features = prepare_features(df, None if task == "clustering" else target, exclude, key)
    if task == "clustering":
        _, summary = kmeans_clusters(features)
        return AutoMl(task, None, summary, None, [])
    trained = train_models(features, task, key)
    return AutoMl(task, target, trained.leaderboard, trained.importances, trained.flags)


