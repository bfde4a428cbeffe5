"""Quality rules under weak supervision, in DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0).  A two-class mixture over
the vote patterns is fitted by expectation-maximisation: it estimates how often
each rule votes each way on good and on bad documents, and so how far its vote
is to be trusted.  The posterior probability of the good class decides.

Patterns number at most 3 ** len(RULES), whatever the corpus, so every step of
the fit is one small aggregate; documents are read once.  Defined cases: null
and empty text have no word and fail the base rule; repeated rows are judged
alike and all returned; an empty table gives an empty result; columns of the
input never clash, as they travel in one struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.scratch import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ITERATIONS = 12
#: Weight of the starting belief in the fit, in documents.
PSEUDO = 2.0
KEEP_AT = 0.5

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_plain", "n_alnum",
]


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes over the MEASURES."""
    words = F.col("n_words")
    chars = F.col("word_chars")
    root = F.sqrt(words.cast("double"))
    return {
        "v_length": _vote(words < MIN_WORDS, words >= 50),
        "v_symbols": _vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 50 <= words),
        "v_dup_lines": _vote(
            F.col("n_dup_lines") * 10 > F.col("n_lines") * 4, (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)
        ),
        "v_repeats": _vote(
            F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT, F.col("n_repeat_words") * 20 <= words
        ),
        "v_variety": _vote((words >= 20) & (F.col("n_distinct") < root), (words >= 20) & (F.col("n_distinct") > root * 3)),
        "v_plain": _vote(F.col("n_plain") * 100 < words * 60, F.col("n_plain") * 100 >= words * 80),
        "v_alnum": _vote(F.col("n_alnum") * 100 < chars * 90, F.col("n_alnum") * 100 >= chars * 94),
        "v_capitals": _vote(F.col("n_upper") * 10 > F.col("n_alnum") * 4, F.col("n_upper") * 10 <= F.col("n_alnum")),
    }


#: The names in ``rules``; votes are made per session.
RULES = ["v_length", "v_symbols", "v_dup_lines", "v_repeats", "v_variety", "v_plain", "v_alnum", "v_capitals"]


def _rows(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )


def _measures(row: DataFrame) -> DataFrame:
    """``doc`` and the MEASURES of its text ``t``; all work on a text stays in its row."""
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = row.select("doc", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), lines.alias("l"))
    row = row.select(
        "doc",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}+[.,;:!?]?$"))).cast("long").alias("n_plain"),
        F.char_length(F.regexp_replace("t", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
    )
    kept = ["doc", *[m for m in MEASURES if m != "n_repeat_words"]]
    starts = F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))
    prints = F.transform(
        F.slice("w", F.lit(1), starts),
        lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, WINDOW)]),
    )
    # The fingerprints of all windows; only a text in which one comes twice needs them in order.
    row = row.select(*kept, prints.alias("p"))
    pairs = F.sort_array(F.transform("p", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    row = row.select(*kept, F.when(F.size(F.array_distinct("p")) < F.size("p"), pairs).alias("s"))
    again = F.transform(
        "s",
        lambda x, i: F.when(
            (x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h), x.i
        ),
    )
    row = row.select(*kept, F.sort_array(F.filter(again, lambda x: x.isNotNull())).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return row.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and by rule and class the chance that a vote cast is a bad one."""

    good_share: float
    says_bad: dict[str, dict[int, float]]

    def accuracies(self) -> dict[str, float]:
        """Chance that a vote cast by the rule is right."""
        g = self.good_share
        return {r: g * (1 - c[1]) + (1 - g) * c[0] for r, c in self.says_bad.items()}

    def posterior(self) -> Column:
        """Probability that a row with the RULES columns is good; an abstention says nothing."""
        odds = F.lit(math.log(self.good_share / (1 - self.good_share)))
        for rule, bad in self.says_bad.items():
            odds = odds + (
                F.when(F.col(rule) < 0, F.lit(math.log(bad[1] / bad[0])))
                .when(F.col(rule) > 0, F.lit(math.log((1 - bad[1]) / (1 - bad[0]))))
                .otherwise(F.lit(0.0))
            )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_votes(patterns: DataFrame, iterations: int = ITERATIONS) -> VoteModel:
    """EM over stored vote patterns with their counts ``n``.

    It starts from "bad if any rule votes bad".  Each round is one aggregate
    over the patterns, and only its few sums reach the driver.  PSEUDO documents
    of the starting belief keep every chance away from 0 and 1, also in an empty
    table: good documents seldom get a bad vote, bad ones as often as not.
    """
    anybad = F.lit(False)
    for r in RULES:
        anybad = anybad | (F.col(r) < 0)
    good = F.when(anybad, F.lit(0.05)).otherwise(F.lit(0.95))
    start = {1: 0.02, 0: 0.5}
    model = None
    for _ in range(iterations):
        weight = {1: F.col("n") * F.col("g"), 0: F.col("n") * (1 - F.col("g"))}
        sums = [F.sum(weight[c]).alias(f"all:{c}") for c in (1, 0)]
        for r in RULES:
            for c in (1, 0):
                sums.append(F.sum(F.when(F.col(r) != 0, weight[c])).alias(f"{r}:{c}:cast"))
                sums.append(F.sum(F.when(F.col(r) < 0, weight[c])).alias(f"{r}:{c}:bad"))
        row = {k: v or 0.0 for k, v in patterns.withColumn("g", good).agg(*sums).first().asDict().items()}
        model = VoteModel(
            (row["all:1"] + PSEUDO) / (row["all:1"] + row["all:0"] + 2 * PSEUDO),
            {
                r: {c: (row[f"{r}:{c}:bad"] + PSEUDO * start[c]) / (row[f"{r}:{c}:cast"] + PSEUDO) for c in (1, 0)}
                for r in RULES
            },
        )
        good = model.posterior()
    return model


def _decide(rows: DataFrame) -> DataFrame:
    votes = materialize(rows.select("doc", *MEASURES, *[v.alias(n) for n, v in rules().items()]), "votes")
    patterns = materialize(votes.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = fit_votes(patterns)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        votes.withColumn("base_failed", failed)
        .withColumn("p_good", F.round(model.posterior(), 6))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows that the rules keep, with the input's columns; stores the rows once, beside their votes."""
    return _decide(_measures(_rows(docs, docs.columns, text))).where("kept").select("doc.*")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, measures, base_failed, kept, p_good and the votes; stores no text."""
    judged = _decide(_measures(_rows(docs, [key], text)))
    return judged.select(F.col("doc").getField(key).alias(key), *MEASURES[:5], "base_failed", "kept", "p_good", *RULES)
