"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is the multiset of its five-word shingles; likeness is the weighted
Jaccard coefficient, and LIKE or more makes a link.

*Signatures.*  Every shingle owns a region (weight x time) into which hashed
darts fall at a steady rate; a dart also hits one of BANDS * ROWS coordinates.
The document keeps, per coordinate, the earliest dart within the weights it
has.  Darts up to a time that shrinks with the document's total weight suffice,
so the work is linear in the text plus the signature.  Two documents agree in a
coordinate with the chance of their weighted likeness; a band joins ROWS
coordinates.  With 48 bands of 7 a pair at exactly 0.8 shares no band once in
80,000 times, at 0.85 less than once in 10 million.

*Links.*  Equal texts fold into one member first.  In each band bucket members
are compared with the bucket's least member, not with each other; exact
likeness of the two shingle multisets decides.  Buckets whose members are of
several classes after that are compared in blocks of at most about BLOCK by
BLOCK members, only across classes and each pair only in the first band it
shares; a block gives no pairs, just the links that join classes.  So no link
between colliding members is lost to the leaders, and no group is expanded.

Only fingerprints and ids are shuffled; texts move once per document in a
candidate pair and side.  Classes come from repeated contraction of the links
in tables of the shared scratch folder.

Texts, not keys, are what is classed: a key repeated with another text is two
members. A class is named by its least key.

Defined cases: null and empty text is nobody's duplicate and its own class;
text without letters and digits is in one class with its exact copies only;
text of fewer than five words has one shingle; repeated rows and equal texts
are in one class; a class without any key has a null name; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import flatwords
from sextant.operators.joins import small_side
from sextant.scratch import materialize

LIKE = 0.8
BANDS, ROWS = 48, 7
#: Members of a block of a mixed bucket, about; a block pair is one unit of work.
BLOCK = 500
#: Bound of the rounds in which classes are contracted; chains halve in each.
CONTRACTIONS = 60

# -- signatures --------------------------------------------------------------


def signatures(
    shingle: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_docs: int, size: int = BANDS * ROWS
) -> np.ndarray:
    """Matrix (document, coordinate) of the earliest darts' fingerprints.

    ``shingle``/``weight``/``owner`` list each document's distinct elements; weights are positive.
    Along the weight axis an element's region is cut at 1, 2, 4, ..., so that darts do not depend on
    the weight a document gives it: a dart counts if it lies below that weight.
    """
    total = np.bincount(owner, weights=weight, minlength=n_docs)
    best_time = np.full(n_docs * size, np.inf)
    best_dart = np.zeros(n_docs * size, np.uint64)
    need = np.flatnonzero(total > 0)
    reach = np.zeros(n_docs)
    reach[need] = size * (math.log(size) + 2) / total[need]
    since = np.zeros(n_docs)
    while len(need):
        _throw(shingle, weight, owner, since, reach, size, best_time, best_dart)
        open_ = np.isinf(best_time.reshape(n_docs, size)[need]).any(axis=1)
        need = need[open_]
        grown = np.zeros(n_docs)
        since = np.full(n_docs, np.inf)
        since[need] = reach[need]
        grown[need] = reach[need] * 2
        reach = grown
    return best_dart.reshape(n_docs, size)


def _throw(shingle, weight, owner, since, reach, size, best_time, best_dart) -> None:
    """Takes in the darts between ``since`` and ``reach`` of each document."""
    level = 0
    while True:
        low = 0.0 if level == 0 else 2.0 ** (level - 1)
        span = 1.0 if level == 0 else low
        element = np.flatnonzero((weight > low) & (reach[owner] > 0))
        if not len(element):
            if not (weight > low).any():
                return
            level += 1
            continue
        seed = flatwords.mix(shingle[element] + np.uint64((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        time = np.zeros(len(element))
        thrown, block = 0, 1
        while len(element):
            # A block of throws at once, twice as many each time: few elements need many.
            number = np.arange(thrown + 1, thrown + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            dart = flatwords.mix(seed[:, None] + number)
            gaps = np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / -span
            gaps[:, 0] += time
            when = np.cumsum(gaps, axis=1)
            doc = owner[element]
            row, throw = np.nonzero((when < reach[doc][:, None]) & (when >= since[doc][:, None]))
            hit, at = dart[row, throw], when[row, throw]
            place = flatwords.mix(hit + np.uint64(1))
            good = low + span * (place >> np.uint64(40)).astype(np.float64) * 2.0**-24 < weight[element][row]
            spot = doc[row] * size + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            _earliest(spot[good], at[good], hit[good], best_time, best_dart)
            live = when[:, -1] < reach[doc]
            element, seed, time = element[live], seed[live], when[live, -1]
            thrown += block
            block = min(block * 2, 1024)
        level += 1


def _earliest(spot, time, dart, best_time, best_dart) -> None:
    np.minimum.at(best_time, spot, time)
    won = best_time[spot] == time
    best_dart[spot[won]] = dart[won]


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One fingerprint per band: matrix (document, band)."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = flatwords.mix(key + parts[:, :, r])
    return key


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, weights and owners of the texts; and two fingerprints of each whole word sequence."""
    word, bounds = flatwords.words(texts)
    shingle, cut = flatwords.shingles(word, bounds)
    sizes = np.diff(cut)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((shingle, owner))
    s, o = shingle[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(s))).astype(np.float64)
    # The order of the words counts: fingerprints of places and words are summed twice over.
    count = np.diff(bounds)
    place = np.arange(len(word)) - np.repeat(bounds[:-1], count)
    mixed = flatwords.mix(word + flatwords.mix(place.astype(np.uint64)))
    pad = np.append(mixed, np.uint64(0))
    whole = []
    for part in (pad, flatwords.mix(pad ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        sums = np.add.reduceat(part, np.minimum(bounds[:-1], len(word)))
        whole.append(np.where(count > 0, sums, np.uint64(0)))
    return s[first], weight, o[first], whole[0], whole[1]


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: ``id``, ``print`` of the raw text, the fingerprints ``h1, h2`` and ``bands``.

    The latter fingerprints are of the word sequence, or without words of the text as it is,
    and null for null and empty text; bands are null without words.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["id"].to_numpy(), batch["text"].tolist()
            for a, b in flatwords.portions(texts):
                part = texts[a:b]
                shingle, weight, owner, h1, h2 = elements(part)
                some = np.bincount(owner, minlength=len(part)) > 0
                filled = some.copy()
                for k in np.flatnonzero(~some):
                    if part[k]:
                        raw = hashlib.blake2b(part[k].encode("utf-8", "replace"), digest_size=16).digest()
                        h1[k], h2[k] = np.frombuffer(raw, np.uint64)
                        filled[k] = True
                keys = band_keys(signatures(shingle, weight, owner, len(part))).view(np.int64)
                yield pd.DataFrame(
                    {
                        "id": ids[a:b],
                        "print": batch["print"].to_numpy()[a:b],
                        "h1": pd.Series(h1.view(np.int64)).astype("Int64").where(filled),
                        "h2": pd.Series(h2.view(np.int64)).astype("Int64").where(filled),
                        "bands": [k if s else None for k, s in zip(keys, some)],
                    }
                )

    rows = _printed(docs, key, text)
    return materialize(rows.mapInPandas(sign, "id string, print long, h1 long, h2 long, bands array<long>").withColumn(
        "id", F.col("id").cast("long")), "signatures")


def _printed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, print of the text): what names a row. Ids are texts here, as numbers beside nulls become floating in pandas."""
    return docs.select(F.col(key).cast("long").cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))


# -- links -------------------------------------------------------------------


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(member, text) of the wanted members, one row each; the text is that of a row with the member's key and print."""
    first = members.join(small_side(wanted), "member", "left_semi").select("member", F.col("id").cast("string").alias("i"), F.col("print").alias("p"))
    first = small_side(materialize(first, "wanted"))
    rows = _printed(docs, key, text)
    found = rows.join(first, F.col("print").eqNullSafe(F.col("p")) & F.col("id").eqNullSafe(F.col("i")))
    return found.select("member", "text").dropDuplicates(["member"])


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: the pairs (a, b) with their exact likeness; each text moves once per pair and side."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct(), "pair-ids")
    texts = _texts(docs, members, ids, key, text)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = batch["ta"].tolist(), batch["tb"].tolist()
            out = np.zeros(len(batch))
            both = [x for pair in zip(left, right) for x in pair]
            for a, b in _even(flatwords.portions(both)):
                shingle, weight, owner, _, _ = elements(both[a:b])
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [(shingle[i:j], weight[i:j]) for i, j in zip(cut, cut[1:])]
                for k in range(0, b - a, 2):
                    out[(a + k) // 2] = flatwords.weighted_jaccard(sets[k], sets[k + 1])
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "like": out})

    full = pairs.join(texts.select(F.col("member").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("member").alias("b"), F.col("text").alias("tb")), "b"
    )
    return materialize(full.select("a", "b", "ta", "tb").mapInPandas(compare, "a long, b long, like double"), "likeness")


def _even(stretches: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches moved to even bounds, so that the two texts of a pair stay together."""
    begin = 0
    for _, b in stretches:
        end = b + b % 2
        if end > begin:
            yield begin, end
            begin = end


def contracted(links: DataFrame) -> DataFrame:
    """Stored (id, root) for every id in a link: root is the least id of its connected component.

    Each round hooks every component to its least neighbour and follows the
    hooks once; links inside a component drop out.
    """
    links = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    nodes = materialize(nodes, "roots")
    edges = links
    for _ in range(CONTRACTIONS):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")).withColumnRenamed("a", "root")
        hook = materialize(hook, "hooks")
        if hook.where("up < root").isEmpty():
            return nodes
        far = hook.select(F.col("root").alias("up"), F.col("up").alias("top"))
        jump = hook.join(far, "up", "left").select("root", F.coalesce("top", "up").alias("up"))
        jump = materialize(jump, "jumps")
        nodes = materialize(
            nodes.join(jump, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots"
        )
        edges = materialize(
            edges.join(jump.select(F.col("root").alias("a"), F.col("up").alias("ra")), "a")
            .join(jump.select(F.col("root").alias("b"), F.col("up").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        if edges.isEmpty():
            return nodes
    raise RuntimeError("components did not settle")


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: id, print, class_no (null without a text) and class_id, the least key of the class."""
    signed = _signed(docs, key, text)
    # Equal word sequences are one member, with a number of its own; null and empty texts take no part.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("first")
    least = signed.where("h1 is not null").groupBy("h1", "h2").agg(first, F.first("bands").alias("bands"))
    numbered = least.select(F.monotonically_increasing_id().alias("member"), "h1", "h2", "first.id", "first.print", "bands")
    members = materialize(numbered, "members")  # fixes the numbers
    rows = members.select("member", F.posexplode("bands").alias("band", "bucket"))
    # The band is part of the bucket's fingerprint.  Only buckets of two or more members matter.
    shared = rows.groupBy("bucket").agg(F.min("member").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(rows.join(materialize(shared, "buckets"), "bucket"), "bucket-rows")
    led = rows.where("member <> lead").select(F.col("lead").alias("a"), F.col("member").alias("b")).distinct()
    links = _verified(led, members, docs, key, text).where(F.col("like") >= LIKE).select("a", "b")
    roots = contracted(links)
    more = _across(rows, roots, members, docs, key, text)
    if not more.isEmpty():
        roots = contracted(links.union(more))
    roots = roots.withColumnRenamed("id", "member").join(members.select("member", "id"), "member")
    names = roots.groupBy("root").agg(F.min("id").alias("name"))
    linked = roots.join(small_side(materialize(names, "names")), "root").select("member", "root", "name")
    named = members.select("h1", "h2", "member", "id").join(linked, "member", "left").select(
        "h1", "h2", F.coalesce("root", "member").alias("class_no"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("name")).alias("name")
    )
    joined = signed.select("id", "print", "h1", "h2").join(named, ["h1", "h2"], "left")
    return joined.select("id", "print", "class_no", F.when(F.col("class_no").isNull(), F.col("id")).otherwise(F.col("name")).alias("class_id"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id`` (the key) and ``class_id`` (least key of its class)."""
    return _classified(docs, key, text).select("id", "class_id")


def _across(rows: DataFrame, roots: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: links (a, b) between members of different classes in buckets where leaders left several.

    A bucket of two has nothing left to compare.  A larger one is dealt out by
    pairs of blocks, so one bucket with very many members is many units of work.
    """
    rooted = rows.where("n > 2").join(roots.withColumnRenamed("id", "member"), "member", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "member"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    mixed = materialize(rooted.join(several, "bucket").select("bucket", "band", "member", "root", "n"), "mixed")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("member"), blocks).cast("int")
    dealt = mixed.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(
        "bucket", "band", "member", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    ids = materialize(mixed.select("member").distinct(), "mixed-ids")
    texts = _texts(docs, members, ids, key, text)
    info = texts.join(members.select("member", "bands").join(small_side(ids), "member", "left_semi"), "member")
    unit = dealt.join(info, "member").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            cut = np.flatnonzero((batch[["bucket", "i", "j"]].diff().iloc[1:] != 0).any(axis=1).to_numpy()) + 1
            pieces = [batch.iloc[x:y] for x, y in zip([0, *cut], [*cut, len(batch)])]
            if held and len(pieces) and any(held[-1][c].iloc[0] != batch[c].iloc[0] for c in ("bucket", "i", "j")):
                yield _block_links(pd.concat(held))
                held = []
            for k, piece in enumerate(pieces):
                held.append(piece)
                if k < len(pieces) - 1:
                    yield _block_links(pd.concat(held))
                    held = []
        if held:
            yield _block_links(pd.concat(held))

    return materialize(unit.mapInPandas(compare, "a long, b long").distinct(), "more-links")


def _block_links(unit: pd.DataFrame) -> pd.DataFrame:
    """Links between classes among the members of one pair of blocks; enough of them to join what is joined."""
    band, same = int(unit["band"].iloc[0]), unit["i"].iloc[0] == unit["j"].iloc[0]
    member, label = unit["member"].to_numpy(), unit["root"].to_numpy().copy()
    keys = np.stack(unit["bands"].to_numpy())[:, :band]
    shingle, weight, owner, _, _ = elements(unit["text"].tolist())
    cut = np.searchsorted(owner, np.arange(len(unit) + 1))
    total = np.bincount(owner, weights=weight, minlength=len(unit))
    first = unit["own"].to_numpy() == unit["i"].iloc[0]
    found = []
    for a in np.flatnonzero(first):
        right = np.arange(len(unit)) > a if same else ~first
        right = np.flatnonzero(right & (label != label[a]))
        right = right[~(keys[right] == keys[a]).any(axis=1)]
        if not len(right):
            continue
        mine, its = shingle[cut[a] : cut[a + 1]], weight[cut[a] : cut[a + 1]]
        take = np.concatenate([np.arange(cut[b], cut[b + 1]) for b in right])
        at = np.minimum(np.searchsorted(mine, shingle[take]), len(mine) - 1)
        low = np.where(mine[at] == shingle[take], np.minimum(its[at], weight[take]), 0.0)
        inside = np.bincount(np.repeat(np.arange(len(right)), cut[right + 1] - cut[right]), weights=low, minlength=len(right))
        for b in right[inside / (total[a] + total[right] - inside) >= LIKE]:
            if label[a] != label[b]:
                found.append((member[a], member[b]))
                label[label == label[b]] = label[a]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without those whose class has a row of a lesser key; input columns only.

    A row without a key comes last in its class. Of rows that repeat a key in
    one class one stays, the first by text and the other columns; rows of
    different classes stay, also under one key.
    """
    named = materialize(_classified(docs, key, text).where("class_no is not null").select("id", "print", "class_no"), "classes")
    rows = materialize(named.groupBy("class_no", "id", "print").agg(F.count("*").alias("copies")), "class-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("first")
    several = rows.groupBy("class_no").agg(first, F.count("*").alias("n")).where("n > 1").select("class_no", "first")
    judged = rows.join(small_side(materialize(several, "class-firsts")), "class_no")
    mine = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("print") == F.col("first.print"))
    gone = materialize(judged.where(~mine).select(F.col("id").alias("_id"), F.col("print").alias("_print")), "gone")
    twice = rows.where("copies > 1").select(F.col("id").alias("_id"), F.col("print").alias("_print"))
    twice = materialize(twice, "twice")
    one = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_print"))
    filled = F.coalesce(F.length(F.col(f"`{text}`")) > 0, F.lit(False))
    kept = docs.join(small_side(gone), one & filled, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(small_side(twice), one & filled, "left_anti")
    copies = kept.where(filled).join(small_side(twice), one, "left_semi")
    groups = [F.col(f"`{key}`").cast("long").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__print")]
    firsts = copies.groupBy(*groups).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return once.union(firsts.select("row.*"))
