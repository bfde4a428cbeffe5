"""URL filters: host-suffix and path-prefix expressions, hash-prefix joins, full digests, precedence.

A url's host and path give expressions: every ending of the host at a dot,
with every beginning of the path whose length some rule has.  Expressions meet
rules in an equi-join on the first bytes of their digests; the full digest then
confirms, and the longest rule wins.

Urls fold into distinct (host, start of path) before anything is expanded or
shuffled, so a host with a third of all pages costs its distinct path starts.
Endings of more labels than any rule's host, and beginnings of lengths no rule
has, cannot match and are not made.  DataFrame operations only.

Defined cases: a null url, or one without "://", has an empty host and path and
fits no rule; repeated rows are judged alike and all returned; an empty table
gives an empty result; without rules every url gets the default; only key and
url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.joins import small_side
from sextant.scratch import materialize

#: Hexadecimal digits of the digest that join; collisions are confirmed away.
PREFIX_DIGITS = 8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a rule's path is empty or starts with one, so the two parts stay apart.
    return F.sha2(F.concat(host, path), 256)


def parsed(pages: DataFrame, url: str) -> DataFrame:
    """``pages`` as a struct ``row`` with the url's ``host`` and ``path``."""
    at = F.instr(F.col(f"`{url}`"), "://")
    rest = F.when(at > 0, F.substr(F.col(f"`{url}`"), at + 3)).otherwise(F.lit(""))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.coalesce(rest, F.lit("")).alias("rest"))
    return base.select(
        "row",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Rows (key, host, path, rule, verdict); ``rules`` has host, path ("" or from a slash on) and verdict."""
    rules = materialize(rules.select("host", "path", "verdict").distinct(), "rules")
    shape = rules.agg(
        F.collect_set(F.char_length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")
    ).first()
    lengths, labels = sorted(shape["lengths"]), shape["labels"] or 0
    rows = parsed(pages.select(key, url), url)
    start = F.substr("path", F.lit(1), F.lit(max(lengths, default=0)))
    ends = rows.select("host", start.alias("start")).distinct()
    parts = F.split("host", r"\.")
    hosts = F.when(
        F.col("host") != "",
        F.transform(
            F.sequence(F.greatest(F.size(parts) - labels, F.lit(0)), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."),
        ),
    )
    paths = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substr("start", F.lit(1), F.lit(n)).alias("p")) for n in lengths] or [F.struct(F.lit(-1).alias("n"), F.lit("").alias("p"))]), lambda x: F.char_length(x.p) == x.n)
    tried = ends.select("host", "start", F.explode(hosts).alias("h")).select("host", "start", "h", F.explode(paths).alias("x"))
    tried = tried.select("host", "start", _digest(F.col("h"), F.col("x.p")).alias("digest"))
    tried = tried.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    full = rules.select(
        _digest(F.col("host"), F.col("path")).alias("full"),
        F.concat("host", "path").alias("rule"),
        F.char_length("host").alias("host_size"),
        "verdict",
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    met = tried.join(small_side(full), "short").where(F.col("digest") == F.col("full"))
    # The longest rule; of equally long ones that of the longer host, then block before allow.
    rank = F.struct(F.char_length("rule").alias("n"), F.col("host_size"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")
    best = met.groupBy("host", "start").agg(F.max(rank).alias("best"))
    best = materialize(best.select(F.col("host").alias("bh"), F.col("start").alias("bs"), "best.rule", "best.verdict"), "verdicts")
    found = rows.join(small_side(best), (F.col("host") == F.col("bh")) & (start == F.col("bs")), "left")
    return found.select(
        F.col("row").getField(key).alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
