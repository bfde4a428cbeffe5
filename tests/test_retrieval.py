"""Search through pivot cells against every distance, and how many cells it looks into."""

import numpy as np
import pytest

from sextant.operators import retrieval as N


def frame(spark, matrix, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"{name} bigint, embedding array<double>")


def plain(matrix, queries, k, metric):
    out = []
    for q, query in enumerate(queries):
        if metric == "l2":
            d = ((matrix - query) ** 2).sum(axis=1)
        else:
            norm = np.linalg.norm(matrix, axis=1) * np.linalg.norm(query)
            d = 1 - np.divide(matrix @ query, norm, out=np.zeros(len(matrix)), where=norm > 0)
        out += [(q, rank, int(i)) for rank, i in enumerate(np.lexsort((np.arange(len(matrix)), np.round(d, 9)))[:k], 1)]
    return out


def clusters(rng, n, size, spread=0.05):
    centres = rng.normal(size=(n, 12)) * 10
    return np.concatenate([c + rng.normal(size=(size, 12)) * spread for c in centres])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_every_distance(spark, metric):
    rng = np.random.default_rng(5)
    matrix = np.concatenate([clusters(rng, 9, 60), rng.normal(size=(300, 12)), np.zeros((4, 12)), np.ones((90, 12)), 1e6 + rng.normal(size=(40, 12))])
    rng.shuffle(matrix)
    queries = np.concatenate([matrix[::60] + 0.01, rng.normal(size=(6, 12)) * 5, np.zeros((1, 12)), np.ones((1, 12))])
    for cell_rows, k in ((20, 7), (200, 3), (10_000, 2000)):
        index = N.PivotIndex(frame(spark, matrix, "vec_id").repartition(4), metric, cell_rows, shard_rows=15)
        found = index.search(frame(spark, queries, "query_id"), k, block=5).hits.collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == plain(matrix, queries, k, metric)


def test_few_cells_are_visited(spark):
    rng = np.random.default_rng(6)
    matrix = clusters(rng, 20, 100)
    queries = matrix[::37] + 0.001
    index = N.PivotIndex(frame(spark, matrix, "vec_id"), cell_rows=25)
    found = index.search(frame(spark, queries, "query_id"), 3)
    visits = found.visits.collect()
    assert len(visits) == len(queries)
    assert sum(r["visited"] for r in visits) < 0.35 * sum(r["cells"] for r in visits)
    assert all(r["visited"] < r["cells"] for r in visits)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.hits.collect()) == plain(matrix, queries, 3, "l2")


def test_missing_numbers_and_empty_tables(spark):
    schema = "vec_id string, embedding array<float>"
    rows = [("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", None), ("a", [1.0, 0.0])]
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0])], "query_id int, embedding array<double>")
    found = N.nearest(spark.createDataFrame(rows, schema), asked, 3).collect()
    assert sorted((r["query_id"], r["vec_id"], r["distance"]) for r in found) == [(1, "a", 0.0), (1, "a", 0.0)]
    assert N.nearest(spark.createDataFrame([], schema), asked, 3).collect() == []
    assert N.nearest(spark.createDataFrame(rows, schema), asked.limit(0), 3).collect() == []
