"""Secret scans in DataFrame operations only.

Base rules find keyed values, access keys and long hexadecimal runs.  Beyond
them every run of key characters is a candidate: a window slides over it, and
the Shannon entropy of the characters in the window is kept up to date from the
counts of the one character that leaves and the one that enters.  Windows above
the limit of the candidate's character class make a span, unless an allow-list
pattern explains the whole candidate or a part of it lies in the window.  What base spans cover is taken out of a
candidate first; each stretch left of it is searched by itself, so a random key
beside an access key in one run is found.

All work on a text stays in its row, so no key is shuffled.  Defined cases:
null and empty text have no span; repeated rows are scanned alike and all
returned; an empty table gives an empty result; the input's columns travel in
one struct and clash with nothing.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rules: pattern, group whose length counts, least length.  Fixed values of the task.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: As BASE["hex"], said so that short runs are no match at all: a run is taken whole either way.
RUNS = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character above which a window of the class is too random; a window of 20 has 4.32 at most.
LIMITS = {"hex": 2.9, "alnum": 3.55, "mixed": 3.75}
#: Candidates that these explain whole are no secrets.
ALLOWED_WHOLE = [
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"^(/?[a-z]+[/_=-])+[a-z]*[0-9]{0,4}$",
]
#: What these match explains the windows that touch it, and no others.
ALLOWED_PARTS = [
    r"(?i)example|sample|dummy|changeme|placeholder|your[_-]",
    r"(?i)0123456789|abcdefghij|(.)\1{5}",
]
ALLOWED = [*ALLOWED_WHOLE, *ALLOWED_PARTS]
ENTROPY = "entropy"
PLACEHOLDER = "[REDACTED]"
#: Matches are numbered in blocks of so many, so that running totals cost little on very long texts.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Totals of what comes before each entry of an array column."""

    def before(array: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<long>").alias("a"))
        return F.aggregate(
            array,
            start,
            lambda acc, x: F.struct((acc.t + x).alias("t"), F.concat(acc.a, F.array(acc.t)).alias("a")),
            lambda acc: acc.a,
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(BLOCK)),
        lambda b: F.slice(lengths, b + 1, F.lit(BLOCK)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda t, x: t + x))
    return F.flatten(F.zip_with(before(sums), blocks, lambda base, b: F.transform(before(b), lambda x: x + base)))


def _matches(row: DataFrame, kept: list[str], pattern: str, group: int, least: int) -> DataFrame:
    """Adds ``m``: the matches of a pattern as (start, end, value), those with a long enough group."""
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    hit = F.col("t").rlike(pattern)
    row = row.select(
        *kept,
        F.when(hit, F.transform(found, lambda x: F.char_length(x).cast("long"))).alias("n"),
        F.when(hit, value).alias("v"),
        F.when(hit, F.transform(F.split("t", pattern, -1), lambda x: F.char_length(x).cast("long"))).alias("g"),
    )
    row = row.select(*kept, "n", "v", "g", F.zip_with(F.slice("g", F.lit(1), F.size("n")), "n", lambda g, n: g + n).alias("s"))
    row = row.select(*kept, "n", "v", "g", F.when(F.col("n").isNotNull(), _running(F.col("s"))).alias("s"))
    spans = F.transform(
        "v",
        lambda v, i: F.struct(
            (F.get("s", i) + F.get("g", i)).alias("start"),
            (F.get("s", i) + F.get("g", i) + F.get("n", i)).alias("end"),
            v.alias("value"),
        ),
    )
    return row.select(
        *kept,
        F.coalesce(
            F.filter(spans, lambda x: F.char_length(x.value) >= least),
            F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"),
        ).alias("m"),
    )


def _ranked(spans: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(rank).alias("rank"), x.end.alias("end")))


def _shares() -> Column:
    """c * log2(c) for the counts a window can hold."""
    return F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(WINDOW + 2)])


def _entropy_spans(row: DataFrame, kept: list[str]) -> DataFrame:
    """Adds ``m``: per stretch of a candidate outside ``base`` the part from its first to its last window above the limit."""
    row = _matches(row, kept, CANDIDATE, 0, WINDOW)
    named = F.filter("m", lambda x: ~_any(x.value, ALLOWED_WHOLE))
    row = row.select(*kept, F.flatten(F.transform(named, _outside_base)).alias("m"))
    row = row.select(*kept, F.transform("m", lambda x: F.struct(x.start.alias("start"), _blanked(x.value).alias("value"))).alias("m"))
    row = row.select(
        *kept,
        F.transform(
            "m",
            lambda x: F.struct(
                x.start.alias("start"),
                F.when(x.value.rlike("^[0-9a-f ]+$") | x.value.rlike("^[0-9A-F ]+$"), F.lit(LIMITS["hex"]))
                .when(x.value.rlike("^[A-Za-z0-9 ]+$"), F.lit(LIMITS["alnum"]))
                .otherwise(F.lit(LIMITS["mixed"]))
                .alias("limit"),
                F.transform(F.split(x.value, ""), lambda c: F.instr(F.lit(ALPHABET + " "), c) - 1).alias("codes"),
            ),
        ).alias("c"),
        _shares().alias("f"),
    )
    none = F.lit(None).cast("int")

    def slide(c: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(-1).alias("blank"),
            none.alias("first"),
            none.alias("last"),
        )

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(c.codes, i), F.get(c.codes, i - WINDOW)
            more, less = F.get(acc.counts, enters), F.get(acc.counts, leaves)
            change = F.when(leaves.isNull(), F.get("f", more + 1) - F.get("f", more)).when(
                leaves == enters, F.lit(0.0)
            ).otherwise(F.get("f", more + 1) - F.get("f", more) + F.get("f", less - 1) - F.get("f", less))
            total = acc["sum"] + change
            counts = F.transform(
                acc.counts,
                lambda n, j: n + F.when(j == enters, F.lit(1)).otherwise(F.lit(0)) - F.when(j == leaves, F.lit(1)).otherwise(F.lit(0)),
            )
            blank = F.when(enters == len(ALPHABET), i).otherwise(acc["blank"])
            # A window holds no blank if the last one is WINDOW or more places back; the first window begins after place -1.
            high = (i - blank >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= c.limit - 1e-9)
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                blank.alias("blank"),
                F.when(acc["first"].isNull() & high, i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when(high, i + 1).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(c.codes) - 1),
            zero,
            step,
            lambda acc: F.struct((c.start + acc["first"]).alias("start"), (c.start + acc["last"]).alias("end")),
        )

    # A text without candidates takes the short way.
    found = F.when(F.size("c") > 0, F.filter(F.transform("c", slide), lambda x: x.start.isNotNull()))
    return row.select(*kept, F.coalesce(found, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("m"))


def _outside_base(x: Column) -> Column:
    """The stretches of a candidate that no base span covers and a window fits in."""

    def left(acc: Column, end: Column) -> Column:
        value = F.substr(x.value, (acc["at"] - x.start + 1).cast("int"), (end - acc["at"]).cast("int"))
        stretch = F.struct(acc["at"].alias("start"), end.alias("end"), value.alias("value"))
        return F.when(end - acc["at"] >= WINDOW, F.concat(acc["out"], F.array(stretch))).otherwise(acc["out"])

    return F.aggregate(
        F.filter("base", lambda b: (b.start < x.end) & (x.start < b.end)),
        F.struct(x.start.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b.end).alias("at"), left(acc, b.start).alias("out")),
        lambda acc: left(acc, x.end),
    )


def _blanked(value: Column) -> Column:
    """The value with blanks, as many as characters, where a part is harmless."""
    for p in ALLOWED_PARTS:
        parts = F.regexp_extract_all(value, F.lit(p), F.lit(0))
        joined = F.zip_with(F.split(value, p, -1), parts, lambda s, m: F.concat(s, F.coalesce(F.regexp_replace(m, ".", " "), F.lit(""))))
        value = F.when(value.rlike(p), F.array_join(joined, "")).otherwise(value)
    return value


def _any(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in [*BASE, ENTROPY]])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x.start.cast("string"), x.end.cast("string"))), ","
    )


def spans(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``doc`` (the named input columns as a struct), ``t``, and the arrays n-by-kind, ``base`` and ``spans``."""
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )
    kept = ["doc", "t"]
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        row = _matches(row, kept, RUNS.get(kind, pattern), group, least)
        row = row.select(*kept, _ranked("m", rank).alias(kind))
        kept.append(kind)
    row = row.select(*kept, F.sort_array(F.concat(*BASE)).alias("base"))
    kept.append("base")
    row = _entropy_spans(row, kept)
    return row.select(*kept, F.sort_array(F.concat("base", _ranked("m", len(BASE)))).alias("spans"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, counts by base kind, digest of the base spans and all spans as text."""
    found = spans(docs, [key], text)
    return found.select(
        F.col("doc").getField(key).alias(key),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The input with every span replaced by PLACEHOLDER, and the length column brought up to date.

    Overlapping spans become one.  Texts without a span, null ones included, are unchanged.
    """
    found = spans(docs, docs.columns, text).select("doc", "t", "spans")
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1).end >= x.start),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1).start.alias("start"),
                        F.greatest(F.get(acc, F.size(acc) - 1).end, x.end).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x.start.alias("start"), x.end.alias("end"))))),
    )
    found = found.select("doc", "t", merged.alias("cut"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("cut")),
        lambda i: F.substr(
            "t",
            (F.when(i > 0, F.get("cut", i - 1).end).otherwise(F.lit(0)) + 1).cast("int"),
            (
                F.coalesce(F.get("cut", i).start, F.char_length("t").cast("long"))
                - F.when(i > 0, F.get("cut", i - 1).end).otherwise(F.lit(0))
            ).cast("int"),
        ),
    )
    found = found.select("doc", F.when(F.size("cut") > 0, F.array_join(pieces, PLACEHOLDER)).alias("new"))
    out = []
    for c in docs.columns:
        old = F.col("doc").getField(c)
        if c == text:
            out.append(F.coalesce("new", old).alias(c))
        elif c == length:
            out.append(F.when(F.col("new").isNotNull(), F.char_length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return found.select(*out)
