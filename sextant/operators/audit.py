"""Rules over text columns: question routing, read-only SQL, and SQL that misses part of a question."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords per label, the first label with a hit wins.
ROUTES: list[tuple[str, list[str]]] = [
    ("report", [
        "generate report", "generate a report", "download report", "export report",
        "create report", "create a report", "executive summary", "shareable report",
        "html report", "pdf report", "analysis report", "write a report",
    ]),
    ("insight", [
        "suggest what to explore", "what should i explore", "what should i ask",
        "proactive insight", "suggest questions", "what to explore", "recommend analyses",
        "suggest analyses", "exploration ideas",
    ]),
    ("quality", [
        "data quality", "clean the data", "clean data", "auto-clean", "autoclean",
        "missing values", "duplicates", "duplicate rows", "data cleaning",
        "quality report", "fix data types", "impute",
    ]),
    ("forecast", [
        "forecast", "predict next", "next month", "next quarter", "next week",
        "projection", "time series forecast", "future sales", "future revenue",
    ]),
    ("stats", [
        "significant difference", "statistically", "t-test", "anova", "p-value",
        "p value", "hypothesis", "correlated with", "correlation with",
        "are there any outliers", "outlier", "difference between",
        "compare regions", "compare groups", "what's correlated",
        "what is correlated", "associated with",
    ]),
    ("ml", [
        "predict", "train", "model", "classification", "regression",
        "cluster", "eda", "analyze", "analysis", "machine learning",
        "feature importance", "ml ", " ml", "exploratory",
        "automl",
    ]),
    ("sql", [
        "how many", "count", "average", "sum", "total", "list", "show me",
        "top", "bottom", "filter", "where", "group by", "select", "query",
        "rows", "columns", "maximum", "minimum", "mean", "median",
        "how much", "which customers", "which houses", "join", "combine",
    ]),
    ("rag", [
        "what did", "tell me about", "explain the previous", "summary of findings",
        "finding", "earlier", "previous analysis", "why did", "what was",
        "recall", "remember", "follow up", "follow-up", "based on prior",
    ]),
]
UNLABELLED = "unlabelled"


def route_label(
    question: Column, routes: Sequence[tuple[str, Sequence[str]]] = ROUTES, has_data: bool = True,
    has_findings: bool = True,
) -> Column:
    """Label of the first rule with a keyword in the question."""
    text = F.lower(F.trim(question))
    usable = [r for r in routes if (r[0] != "sql" or has_data) and (r[0] != "rag" or has_findings)]
    label = F
    for name, words in usable:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        label = label.when(hit, F.lit(name))
    return label.otherwise(F.lit(UNLABELLED))


def route_questions(df: DataFrame, column: str, **options) -> DataFrame:
    return df.withColumn("route", route_label(F.col(column), **options))


# -- read-only SQL ----------------------------------------------------------

# Words no read-only statement may hold.
FORBIDDEN_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "MERGE",
    "GRANT", "REVOKE", "EXEC", "EXECUTE", "ATTACH", "DETACH", "PRAGMA", "VACUUM",
]
FORBIDDEN_PATTERN = r"(?i)\b(" + "|".join(FORBIDDEN_WORDS) + r")\b"
LEADING_PATTERN = r"(?i)^\s*(SELECT|WITH)\b"
LINE_COMMENT = r"--[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"


def is_read_only(sql: str) -> tuple[bool, str]:
    """Gate in front of one statement: (allowed, reason if not)."""
    bare = re.sub(BLOCK_COMMENT, "", re.sub(LINE_COMMENT, "", (sql or "").strip().rstrip(";"))).strip()
    checks = [
        (not (sql or "").strip(), "empty"),
        (re.search(FORBIDDEN_PATTERN, bare) is not None, "forbidden_word"),
        (re.search(LEADING_PATTERN, bare) is None, "not_select"),
        (";" in bare, "multiple_statements"),
    ]
    reason = next((name for failed, name in checks if failed), "")
    return reason == "", reason


def _stripped(text: Column) -> Column:
    """Text without the white space at both ends, as ``str.strip`` sees it."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def audit_sql(df: DataFrame, column: str) -> DataFrame:
    """The same gate over a column of logged SQL: ``ok`` and ``reason`` ("ok" if allowed)."""
    sql = _stripped(F.coalesce(F.col(column), F.lit("")))
    bare = F.regexp_replace(sql, ";+\\z", "")
    bare = _stripped(F.regexp_replace(F.regexp_replace(bare, LINE_COMMENT, ""), BLOCK_COMMENT, ""))
    reason = (
        F.when(sql == "", "empty")
        .when(bare.rlike(FORBIDDEN_PATTERN), "forbidden_word")
        .when(~bare.rlike(LEADING_PATTERN), "not_select")
        .when(F.contains(bare, F.lit(";")), "multiple_statements")
        .otherwise("ok")
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok")


# -- does the SQL cover the question? ---------------------------------------

# Wording of questions and shapes of SQL.
ASKS_TOP = (
    r"(?i)\btop\s+(\d+)\b|\b(?:first|best)\s+(\d+)\b|\brank(?:ed)?\s+(?:within|by|per)\b|"
    r"\bwithin\s+(?:each|every)\b|\bper\s+(?:group|season|category|region|country|competition)\b"
)
ASKS_COUNTED_TOP = r"(?i)\btop\s+(\d+)\b|\b(?:first|best)\s+(\d+)\b"
ASKS_PER_GROUP = r"(?i)\bper\b|\bwithin\b|\beach\b|\bby (?:season|competition|region|category|country|group)\b"
ASKS_THRESHOLD = (
    r"(?i)\b(?:only\s+(?:for|where|show)|only\s+seasons?|with\s+more\s+than|with\s+at\s+least|"
    r"having\s+more\s+than|more\s+than\s+\d+|at\s+least\s+\d+|greater\s+than\s+\d+|"
    r"fewer\s+than\s+\d+|less\s+than\s+\d+\s+(?:matches|rows|records|games))\b"
)
ASKS_SHARE = r"(?i)\bpercent(?:age)?\s+of\s+total\b|\b% of total\b|\bshare of\b|\bproportion of total\b"
HAS_WINDOW = r"(?i)\b(ROW_NUMBER|RANK|DENSE_RANK)\s*\(|\bOVER\s*\("
HAS_RANK_FILTER = (
    r"(?i)\b(?:rnk|rank|row_num|row_number|rn|rnum)\b\s*<=?\s*\d+|\bWHERE\b[^;]*\b(?:rnk|rank|row_num|rn)\b|<=\s*\d+"
)
HAS_LIMIT = r"(?i)\bLIMIT\s+\d+\b"
HAS_GROUP_FILTER = (
    r"(?i)\bHAVING\b|\b(COUNT|SUM|AVG)\s*\([^)]*\)\s*[><=]|"
    r"\bAS\s+\w*(count|matches|total|cnt)\w*\b[\s\S]*\bWHERE\b[\s\S]*[><=]\s*\d+"
)
HAS_TOTAL = r"(?i)\bOVER\s*\(|/\s*\(|\bTOTAL\b"
HAS_SHARE = r"(?i)100|percent|pct|share|proportion|/|\bOVER\s*\("


def coverage_issues(question: Column, sql: Column) -> Column:
    """Codes of what the question asks for and the SQL lacks; empty if nothing is."""
    ranked, grouped, windowed = question.rlike(ASKS_TOP), question.rlike(ASKS_PER_GROUP), sql.rlike(HAS_WINDOW)
    share = question.rlike(ASKS_SHARE)
    rules = {
        "needs_window": ranked & grouped & ~windowed,
        "needs_rank_filter": ranked & grouped & windowed & ~sql.rlike(HAS_RANK_FILTER),
        "needs_limit": ranked & ~grouped & question.rlike(ASKS_COUNTED_TOP) & ~windowed & ~sql.rlike(HAS_LIMIT),
        "needs_having": question.rlike(ASKS_THRESHOLD) & ~sql.rlike(HAS_GROUP_FILTER),
        "needs_total": share & ~sql.rlike(HAS_TOTAL),
        "needs_share": share & ~sql.rlike(HAS_SHARE),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]))


def audit_coverage(df: DataFrame, question: str, sql: str) -> DataFrame:
    issues = coverage_issues(F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(sql), F.lit("")))
    return df.withColumn("issues", issues)
