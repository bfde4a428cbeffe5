"""Ranked search against scoring every document, against the check SQL, and the bounds against true scores."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from sextant.llm import lexical_search
from sextant.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, doc_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """Every item against every document."""
    counts = [(i, Counter(split(t))) for i, t, *_ in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    everything = sum(n for _, _, n in counts)
    out = []
    for item, text in {(i, t or "") for i, t, *_ in items}:
        found = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * len(counts)) // everything
            score = 0
            for t in set(split(text)):
                df = sum(t in other for _, other, _ in counts)
                w = math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=repr)


def made(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)] + ["Été", "日本", "naïve", "3rd"]
    docs = []
    for k in range(300):
        docs.append((k, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([1, 3, 20, 200])))))
    docs += [(1000 + k, "w58, w59! W58") for k in range(40)]  # copies: a tie of many
    docs += [(5, "w1 w1"), (5, "w1 w1"), (None, "w58 w59 w58"), (2000, None), (2001, ""), (2002, "-- !"), (2003, "w3 " * 30_000)]
    return [(i, t, 9, "clash") for i, t in docs]


def test_equals_scoring_everything(spark, monkeypatch):
    docs = corpus()
    items = [(1, "w58 w59"), (2, "W1, w1 w2"), (3, None), (4, ""), (5, "unknown"), (5, "日本 Été ÉTÉ"), (6, "w3"), (6, "w3"), (None, "w7 w40 3rd")]
    items = [(i, t, 1) for i, t in items]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    expected = plain(docs, items)
    assert made(lexical_search.search(df, spark.createDataFrame(items, ITEMS))) == expected
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 3)  # several blocks of queries
    assert made(lexical_search.search(df, spark.createDataFrame(items, ITEMS))) == expected


def test_bounds_are_never_too_low():
    docs = corpus()
    texts = [t for _, t, *_ in docs]
    owner, found, count, sizes = lexical_search._term_counts(texts)
    vocabulary = np.unique(found)
    bounds = np.array([0, len(vocabulary)])
    query = lexical_search._Queries([("all",)], vocabulary, np.ones(len(vocabulary), np.int64), bounds, np.arange(len(vocabulary)))
    query.docs, query.all_terms = int((sizes > 0).sum()), int(sizes.sum())
    members = []
    for d in np.flatnonzero(sizes):
        level = np.minimum(np.frexp(count[owner == d])[1], lexical_search.TOP + 1)
        steps = np.concatenate([np.arange(n, dtype=np.uint64) for n in level])
        pairs = np.repeat(found[owner == d], level) + steps * lexical_search._LEVEL_STEP
        members.append((int(d), 0, int(sizes[d]), pairs))
    row = lexical_search._block(members)
    at = np.array(row[2], np.int64)
    (_, upper), = lexical_search._block_bounds(query, at, row[3], row[4])
    for column, d in enumerate(row[0]):
        tf = count[owner == d].astype(np.int64)
        true = int(((1_000_000_000 * tf) // (1000 * tf + query.damping(sizes[d : d + 1].astype(np.int64)))).sum())
        assert upper[0, column] >= true


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a", 1, "")], DOCS), items.limit(0)).collect() == []


def test_check_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    expected = sorted(duck.execute(ORACLES["op12_lexical_search"]).fetchall(), key=repr)
    assert made(QUERIES["op12_lexical_search"](spark, folder)) == expected
    assert len(expected) == 400
