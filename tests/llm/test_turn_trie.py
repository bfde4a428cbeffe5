"""The trie of conversations against plain Python, with containers burst at every size, and against the check SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from sextant.llm import turn_trie
from sextant.llm.queries import ORACLES, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, h1 string, seq int"


def plain(rows):
    """Nodes by walking every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = turns.get(c - c % 100, [])[:h] + v[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, found in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += kids[key] == 0
            saved[key[:d]] += (len(found) - 1) * len(key[-1][1]) if key else 0
    return sorted(
        (min(f), len(k), min(members[k[:-1]]) if k else -1, len(f), kids[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, f in members.items()
    )


def made(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def talks(rng, convs, texts, longest):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(texts), "x", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [0, 50, 10**9])
def test_equals_a_walk(spark, limit):
    rng = random.Random(limit)
    rows = talks(rng, [*range(0, 60), *range(100, 400, 3)], ["a", "bb", None, "", "é👩"], 4)
    rows += [(7, None, "user", "before all", "x", 1), (8, None, None, None, "x", 1)]
    # A large group of equal conversations, one of near-equal ones, a very long one, and rows of no conversation.
    rows += [(c, t, "user", f"same {t}", "x", 1) for c in range(1000, 1300) for t in range(8)]
    rows += [(c, t, "user", f"near {t}" if t < 7 else f"own {c}", "x", 1) for c in range(2001, 2040) for t in range(8)]
    rows += [(5000, t, "user", "again and again", "x", 1) for t in range(400)]
    rows += [(None, 1, "user", "lost", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(turn_trie.trie(df, limit)) == plain(rows)


def test_turnless_and_missing_heads(spark):
    # 101 to 105 have fewer turns than their head, and conversation 100 is absent.
    rows = [(c, 0, "user", "only", "x", 1) for c in range(101, 106)] + [(-3, 0, "a", "b", "x", 1), (-100, 1, "q", "r", "x", 1)]
    assert made(turn_trie.trie(spark.createDataFrame(rows[:5], SCHEMA))) == plain(rows[:5])
    found = turn_trie.trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 0").collect()
    assert [(r.n_convs, r.conv_id, r.parent_conv_id) for r in found] == [(7, -100, None)]


def test_empty(spark):
    assert turn_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_check_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    result = duck.execute(ORACLES["op11_turn_trie"])
    names = [d[0] for d in result.description]
    rows = [dict(zip(names, r)) for r in result.fetchall()]
    expected = sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in rows)
    assert made(QUERIES["op11_turn_trie"](spark, folder)) == expected
    table = duck.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert plain(table) == expected
