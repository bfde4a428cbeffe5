"""Label groups of any size against comparing every pair, through leaders and through the index."""

import random

import pytest

from sextant.functions.similarity import alike, normalize
from sextant.operators import labels as L


def plain(rows):
    """{frozenset of labels in a group} by the greedy rule over all pairs."""
    counts = {}
    for x in rows:
        if x is not None and x.strip(" "):
            counts[x.strip(" ")] = counts.get(x.strip(" "), 0) + 1
    left = sorted(counts, key=lambda x: (-counts[x], x.encode()))
    left = [(x, normalize(x)) for x in left]
    groups = []
    while left:
        seed, *rest = left
        like = [x for x in rest if alike(seed[1], x[1])]
        taken = set(like)
        left = [x for x in rest if x not in taken]
        if like:
            groups.append((len(groups) + 1, frozenset([seed[0], *(x for x, _ in like)])))
    return groups


def found(df, columns=("x",)):
    groups = {}
    for r in L.similar_label_groups(df, columns and list(columns)).collect():
        groups.setdefault(r["group_no"], set()).add(r["label"])
    return sorted((k, frozenset(v)) for k, v in groups.items())


def misspelt(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcxyz") + word[at:], word.upper(), word[:at] + "-" + word[at:]])


def words(n, seed):
    rng = random.Random(seed)
    parts = ["ber", "lin", "ka", "to", "san", "mu", "ri", "ox", "port", "vel", "za", "que", "dorf", "y", "77", "ham"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    more = [misspelt(rng, rng.choice(base)) for _ in range(n // 3)]
    return [w for w in [*base, *more] for _ in range(rng.randint(1, 3))] + [None, "", "  ", "--", "us", "US", "u s a"]


@pytest.mark.parametrize("leaders, taken, n", [(128, 16, 60), (128, 16, 700), (4, 1, 300), (2, 10**9, 500)])
def test_equals_all_pairs(spark, monkeypatch, leaders, taken, n):
    monkeypatch.setattr(L, "LEADERS", leaders)
    monkeypatch.setattr(L, "TAKEN", taken)
    rows = words(n, n + leaders)
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    assert found(df) == plain(rows)


def test_five_thousand_labels(spark):
    rows = words(3900, 5)
    assert len({x for x in rows if x}) > 4000
    assert found(spark.createDataFrame([(x,) for x in rows], "x string")) == plain(rows)


def test_more_labels_than_a_category_has(spark):
    cities = [f"{a}{b}" for a in ("qar", "wex", "zul", "fyn", "hob", "jip", "kov", "dag", "nym", "tus") for b in "bcdfghjkl"]
    rows = [*[c * 2 for c in cities], "San Francisco", "San Fransisco", "san francisco"]
    df = spark.createDataFrame([(x, str(i), "2024-01-02") for i, x in enumerate(rows)], "city string, amount string, day string")
    status = {r["column"]: r["status"] for r in L.category_columns(df).collect()}
    assert status == {"city": "categories", "amount": "bigint", "day": "timestamp"}
    groups = [(k, g) for k, g in found(df, None) if "San Francisco" in g]
    assert groups and groups[0][1] == {"San Francisco", "San Fransisco", "san francisco"}
    assert {k for k, _ in found(df, None)} == {k for k, _ in plain(rows)}


def test_labels_of_all_kinds(spark):
    df = spark.createDataFrame([], "x string, y int")
    assert L.similar_label_groups(df).collect() == []
    assert L.similar_label_groups(df.select("y")).collect() == []
    assert L.similar_label_groups(spark.createDataFrame([("日本",), ("日本 ",), ("--",)], "x string"), ["x"]).collect() == []
