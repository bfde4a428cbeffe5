"""Table differences: against counting rows, odd values, and how much is shuffled."""

import random
from collections import Counter

from sextant.operators.difference import table_diff
from sextant.sources.registry import same_content


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    none = context._jvm.java.util.ArrayList()
    stages = store.stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_equals_counting(spark):
    rng = random.Random(2)
    cells = [(None, "a", 0.0), (None, None, -0.0), (1, None, float("nan")), (1, "a", None), (2, "", 1.5), (0, "a", 2.5)]
    schema = "k int, s string, x double"
    for n in (0, 3, 200):
        left, right = ([rng.choice(cells) for _ in range(n)] for _ in range(2))
        left += [(7, "same", 1.0)] * 50
        right += [(7, "same", 1.0)] * 50
        counts = [Counter(tuple("nan" if v != v else v for v in r) for r in side) for side in (left, right)]
        expected = {(k, counts[0][k], counts[1][k]) for k in counts[0].keys() | counts[1].keys() if counts[0][k] != counts[1][k]}
        a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema)
        found = {(tuple("nan" if v is not None and v != v else v for v in r[:3]), r["n_left"], r["n_right"]) for r in table_diff(a, b).collect()}
        assert found == expected
        assert same_content(a, b) == (not expected)


def test_nulls_inside_lists(spark):
    schema = "a array<int>, s struct<p:int,q:int>"
    left = spark.createDataFrame([([1, None], (1, None))], schema)
    right = spark.createDataFrame([([1], (1, None)), ([1, None], (None, 1))], schema)
    assert table_diff(left, right).count() == 3
    assert table_diff(left, left).count() == 0
    assert table_diff(left, left).columns == ["a", "s", "n_left", "n_right"]


def test_shuffles_follow_the_difference(spark):
    rows = spark.range(200_000, numPartitions=8).selectExpr("id", "repeat(md5(cast(id as string)), 4) as text")
    changed = rows.selectExpr("id", "if(id % 50000 = 7, 'x', text) as text")
    before = shuffled(spark)
    found = table_diff(rows, changed).collect()
    few = shuffled(spark) - before
    assert len(found) == 8 and {r["n_left"] + r["n_right"] for r in found} == {1}
    before = shuffled(spark)
    assert table_diff(rows, rows.selectExpr("id", "concat(text, 'x') as text")).count() == 400_000
    all_of_them = shuffled(spark) - before
    assert few < all_of_them / 3
    # Sums of buckets alone: the tables are 28 MB of text, and each of 16 tasks sums at most 2^16 buckets.
    assert same_content(rows, rows.orderBy("text"))
