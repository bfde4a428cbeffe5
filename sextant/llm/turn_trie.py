"""Prefix trie of conversations, built as a burst trie.

Every turn is a 128-bit id of (role, text); a conversation is a sequence of
ids.  Equal sequences are folded first, with the digest of their sorted
conversation ids.  All sequences start in one suffix container under the root.
A container with too many ids is burst: its head becomes a node of its own and
its suffixes go to containers under the next turn id.  The rounds go on with
what is still too large, so a first turn that a third of all conversations
share is dealt out by their second turn.  The containers that remain are
sorted and swept: one pass over sorted suffixes with a stack of open nodes
gives all nodes below the head.  Burst heads are then put together from their
children, deepest first, by sums that are combined before they are shuffled.

Texts are read once and never shuffled.  The ids of one conversation (20 bytes
a turn) are one row; the conversation ids at one node stream through a digest
in sorted pieces of 512 and are never held together.  There are as many rounds
as turns shared by sequences of more than ``LIMIT`` ids.

Defined cases: turns are ordered by turn, null first, equal ones by their id;
null role or text is empty; rows without conv_id belong to no conversation and
are ignored; repeated rows are turns of their own; an empty table has no node,
not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.joins import small_side
from sextant.scratch import materialize

#: Ids in a container above which it is burst; one sequence is never burst.
LIMIT = 20_000
#: Conversation ids joined into one piece on their way to a digest.
PIECE = 512
#: Conversations that share the head of the first of them, and turns taken from it at most.
FAMILY = 100
HEADS = 6

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and seq: the turns in order as structs of two hashes and the code points of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).alias("n")
    )
    turns = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    sorted_turns = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(
        F.transform(sorted_turns, lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t.n.alias("n"))).alias("seq")
    )


def rebuilt(own: DataFrame) -> DataFrame:
    """Each sequence with its first h turns taken from the first conversation of its family; h is crc32(conv_id) % 6."""
    head = own.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, HEADS - 1).alias("head")
    )
    based = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    empty = F.slice("seq", 1, 0)
    both = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), h), F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0))))
    return based.join(head, "base", "left").select("conv_id", both.alias("seq"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of conversation ids with one key, joined, in sorted rows."""
    for batch in batches:
        out = []
        last, ids = None, []
        for a, b, c in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["conv_id"].tolist()):
            if (a, b) != last or len(ids) == PIECE:
                if ids:
                    out.append((*last, ids[0], len(ids), ",".join(map(str, ids))))
                last, ids = (a, b), []
            ids.append(c)
        if ids:
            out.append((*last, ids[0], len(ids), ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=["k1", "k2", "first", "n", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least conversation, count and digest of each key, from its sorted pieces."""
    key, least, total, digest = None, 0, 0, None
    for batch in batches:
        out = []
        for a, b, first, n, ids in zip(*(batch[c].tolist() for c in ("k1", "k2", "first", "n", "ids"))):
            if (a, b) != key:
                if key is not None:
                    out.append((least, total, digest.hexdigest()))
                key, least, total, digest = (a, b), first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            total += n
        yield pd.DataFrame(out, columns=["conv", "members", "ends"])
    if key is not None:
        yield pd.DataFrame([(least, total, digest.hexdigest())], columns=["conv", "members", "ends"])


def folded(rows: DataFrame) -> DataFrame:
    """Distinct sequences with their least conversation, member count and digest of members; ``rows`` is stored."""
    keyed = rows.select(
        F.xxhash64("seq").alias("k1"), F.xxhash64(F.lit(1), "seq", F.size("seq")).alias("k2"), "conv_id"
    ).repartitionByRange("k1", "k2", "conv_id")
    pieces = keyed.sortWithinPartitions("k1", "k2", "conv_id").mapInPandas(
        _pieces, "k1 long, k2 long, first long, n long, ids string"
    )
    digests = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(
        _digests, "conv long, members long, ends string"
    )
    return digests.join(rows, F.col("conv") == F.col("conv_id")).drop("conv_id")


class _Node:
    __slots__ = ("depth", "size", "conv", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = _NO_MEMBERS
        self.below: list[list] = []

    def take(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n += n

    def closed(self, out: list) -> list:
        """Row of this node; the rows of its children leave with its name on them."""
        for row in self.below:
            row[2] = self.conv
            out.append(row)
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        return [self.conv, self.depth, None, self.n, self.children, self.leaves, self.saved, self.ends]


def _close_to(stack: list[_Node], height: int, out: list) -> None:
    while len(stack) > height:
        node = stack.pop()
        row = node.closed(out)
        above = stack[-1]
        above.take(node.conv, node.n)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        above.below.append(row)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of containers whose suffixes come sorted; the head of each comes last, with its keys."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    keys = ["h1", "h2", "p1", "p2"]
    head, stack, before = None, [], []

    def frame(out: list) -> pd.DataFrame:
        # As objects first: numbers beside a missing value would become floating.
        made = pd.DataFrame(out, columns=[*columns, *keys], dtype=object)
        return made.astype({c: "Int64" for c in [*columns[:-1], *keys]})

    def finish(out: list) -> None:
        _close_to(stack, 1, out)
        top = stack.pop()
        row = top.closed(below := [])
        out.extend([*r, None, None, None, None] for r in below)
        out.append([*row, *head])

    for batch in batches:
        out: list = []
        fields = ("h1", "h2", "p1", "p2", "depth", "last", "members", "conv", "ends", "a", "b", "n")
        for h1, h2, p1, p2, depth, last, members, conv, ends, a, b, n in zip(*(batch[c] for c in fields)):
            suffix = list(zip(a.tolist(), b.tolist()))
            if head is None or (h1, h2) != head[:2]:
                if head is not None:
                    finish(out)
                head, before = (h1, h2, p1, p2), []
                stack = [_Node(depth, last)]
            same = 0
            for x, y in zip(before, suffix):
                if x != y:
                    break
                same += 1
            below: list = []
            _close_to(stack, same + 1, below)
            out.extend([*r, None, None, None, None] for r in below)
            for k in range(same, len(suffix)):
                stack.append(_Node(depth + k + 1, int(n[k])))
            stack[-1].take(conv, members)
            stack[-1].ends = ends
            before = suffix
        yield frame(out)
    if head is not None:
        finish(out := [])
        yield frame(out)


def nodes(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the trie over distinct sequences, as ``folded`` gives them."""
    none = F.lit(None).cast("long")
    zero, one = (F.lit(v).cast("long") for v in (0, 1))
    # The root's head is (0, 0); (0, 1) is no head, so the root has no parent.
    rows = distinct.select(
        F.lit(0).alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("p1"), one.alias("p2"), F.lit(0).alias("last"), "members", "conv", "ends", "seq",
    )
    settled, burst = [], []
    while True:
        rows = materialize(rows, "suffixes")
        here = F.size("seq") == F.col("depth")
        heads = rows.groupBy("depth", "h1", "h2").agg(
            F.count("*").alias("held"),
            F.sum(F.size("seq") - F.col("depth")).alias("ids"),
            *[F.max(c).alias(c) for c in ("p1", "p2", "last")],
            F.sum(F.when(here, F.col("members"))).alias("own"),
            F.min(F.when(here, F.col("conv"))).alias("own_conv"),
            F.max(F.when(here, F.col("ends"))).alias("own_ends"),
        )
        large = materialize(heads.where((F.col("held") > 1) & (F.col("ids") > limit)), "burst-heads")
        if large.isEmpty():
            settled.append(rows)
            break
        burst.append(large)
        names = small_side(large.select("h1", "h2"))
        settled.append(rows.join(names, ["h1", "h2"], "left_anti"))
        step = F.element_at("seq", F.col("depth") + 1)
        rows = rows.join(names, ["h1", "h2"], "left_semi").where(~here).select(
            (F.col("depth") + 1).alias("depth"),
            F.xxhash64("h1", step.a, step.b).alias("h1"), F.xxhash64("h2", step.b, step.a).alias("h2"),
            F.col("h1").alias("p1"), F.col("h2").alias("p2"), step.n.alias("last"), "members", "conv", "ends", "seq",
        )
    columns = ["depth", "h1", "h2", "p1", "p2", "last", "members", "conv", "ends"]
    suffixes = reduce(DataFrame.unionByName, settled).select(
        *columns, F.slice("seq", F.col("depth") + 1, F.size("seq") - F.col("depth")).alias("suffix")
    )
    dealt = suffixes.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "suffix")
    swept = dealt.select(*columns, *[F.col(f"suffix.{c}").alias(c) for c in ("a", "b", "n")]).mapInPandas(
        _sweep, NODE + ", h1 long, h2 long, p1 long, p2 long"
    )
    swept = materialize(swept, "swept")
    inner = swept.where("h1 is null").drop("h1", "h2", "p1", "p2")
    tops = swept.where("h1 is not null")
    joined, below = [], tops
    for level in range(len(burst) - 1, -1, -1):
        children = below.where(F.col("depth") == level + 1).groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
            F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.count("*").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"),
        )
        total = F.col("n") + F.coalesce("own", F.lit(0))
        made = burst[level].join(children, ["h1", "h2"]).select(
            F.least("least", "own_conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
            none.alias("parent_conv_id"), total.alias("n_convs"), "n_children", "n_leaves",
            (F.col("saved") + (total - 1) * F.col("last")).alias("saved_tokens"),
            F.coalesce("own_ends", F.lit(_NO_MEMBERS)).alias("ends_sha256"), "h1", "h2", "p1", "p2",
        )
        made = materialize(made, "heads")
        joined.append(made)
        below = tops.unionByName(made)
    if not joined:
        return inner.unionByName(tops.drop("h1", "h2", "p1", "p2"))
    above = reduce(DataFrame.unionByName, joined)
    named = small_side(above.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("above")))
    heads = tops.unionByName(above).join(named, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("above"))
    return inner.unionByName(heads.drop("h1", "h2", "p1", "p2", "above"))


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per node of the trie over rebuilt conversations."""
    own = materialize(sequences(conversations), "own-turns")
    rows = materialize(rebuilt(own), "rebuilt")
    return nodes(folded(rows), limit)
