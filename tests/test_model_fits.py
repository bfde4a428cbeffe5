"""How the candidates of a model board are fitted: one fit for boosted models that differ in rounds, rows dealt out."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sextant.operators import ml


def _rows(spark, n=400):
    rows = spark.range(n).select(
        "id", *[(F.xxhash64("id", F.lit(i)) % 100).cast("double").alias(f"x{i}") for i in range(3)]
    )
    return rows.withColumn("y", F.col("x0") * 2 + F.col("x1") * F.col("x2") / 50)


def test_first_trees_are_the_model_of_fewer_rounds(spark):
    rows = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(_rows(spark))
    rows = rows.withColumnRenamed("y", "_y").coalesce(1).cache()
    short, long = (
        GBTRegressor(featuresCol="features", labelCol="_y", maxIter=n, maxDepth=3, stepSize=0.1, seed=1).fit(rows) for n in (3, 6)
    )
    expected = {r["id"]: r["prediction"] for r in short.transform(rows).collect()}
    found = {r["id"]: r["prediction"] for r in ml._predicted_by_first(long, 3, rows, "regression").collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)


def test_each_depth_is_boosted_once_over_dealt_rows(spark, monkeypatch):
    fits, fit = [], ml.GBTRegressor.fit

    def noted(self, rows, *args):
        fits.append((self.getMaxDepth(), self.getMaxIter(), rows.rdd.getNumPartitions()))
        return fit(self, rows, *args)

    grid = [
        ("boosting", f"d{d} n{n}", GBTRegressor(featuresCol="features", labelCol="_y", maxIter=n, maxDepth=d, seed=1))
        for d in (1, 2) for n in (2, 4)
    ]
    monkeypatch.setattr(ml.GBTRegressor, "fit", noted)
    monkeypatch.setattr(ml, "_grid", lambda *_: grid)
    monkeypatch.setattr(ml, "FIT_TASK_ROWS", 100, raising=False)
    trained = ml.train_models(ml.Features(_rows(spark), ["x0", "x1", "x2"], [], "y", ["id"]), "regression", ["id"])
    assert sorted(fits) == [(1, 4, 4), (2, 4, 4)]
    assert sorted(r["model"] for r in trained.leaderboard.collect()) == ["d1 n2", "d1 n4", "d2 n2", "d2 n4"]
    assert trained.importances.count() == 3
