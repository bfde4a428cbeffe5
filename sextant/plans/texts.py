"""Text, retrieval and rule queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import audit as A
from sextant.operators import chunk_table as K
from sextant.operators import retrieval as N
from sextant.operators import texts as X
from sextant.plans.catalog import ORACLES, Tables, query
from sextant.plans.inputs import SQL_LOG_SQL, sql_log
from sextant.scratch import scratch_dir

# -- chunks -----------------------------------------------------------------

# Texts hold no blank lines, so a text is one paragraph: short ones stay, long ones are packed word by word.
_CHUNK_SQL = r"""
    plain as (select doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents),
    packed as (select doc_id, source, case when length(text) = 0 then [] when length(text) <= 500 then [text] else
        list_reduce(list_transform(regexp_split_to_array(text, '\s+'), lambda w: [w]), lambda acc, w:
            case when length(acc[-1]) + 1 + length(w[1]) <= 500
                 then list_concat(acc[:-2], [acc[-1] || ' ' || w[1]]) else list_concat(acc, w) end) end as parts from plain),
    chunked as (select doc_id, source, i - 1 as chunk_index,
        case when i = 1 then parts[1] else trim(right(parts[i - 1], 50) || ' ' || parts[i]) end as text
        from (select *, unnest(range(1, len(parts) + 1)) as i from packed)),
    chunks as (select source || '_' || substr(md5(source || ':' || cast(doc_id as varchar) || ':' || cast(chunk_index as varchar)
        || ':' || substr(text, 1, 50)), 1, 12) as id, doc_id, source as source_type, chunk_index, text from chunked)
"""


@query("doc_chunks", f"with {_CHUNK_SQL} select * from chunks")
def doc_chunks(t: Tables) -> DataFrame:
    return X.chunk_documents(t.documents, "doc_id", "text", F.col("source"))


@query("chunk_counts", f"with {_CHUNK_SQL} select source_type, count(*) as n_chunks from chunks group by 1")
def chunk_counts(t: Tables) -> DataFrame:
    return X.chunk_counts(X.chunk_documents(t.documents, "doc_id", "text", F.col("source")))


@query(
    "chunk_upsert",
    """
    with c as (select 'd' || cast(doc_id as varchar) as id, text, cast(0 as bigint) as version from documents where lang <> 'de'),
    n as (select 'd' || cast(doc_id as varchar) as id, upper(source) as text, cast(quality as bigint) as version
          from documents join labels using (doc_id) union all
          select 'd' || cast(doc_id as varchar), lower(source), 2 from documents where lang = 'de'),
    b as (select *, 1 as fresh from n union all select *, 0 from c)
    select id, text, version from (
      select *, row_number() over (partition by id order by fresh desc, version desc) as k from b) where k = 1
    """,
)
def chunk_upsert(t: Tables) -> DataFrame:
    return X.upsert_chunks(*_chunk_versions(t))


def _chunk_versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A chunk table and the rows to be put into it."""
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")
    current = t.documents.where("lang <> 'de'").select(key, "text", F.lit(0).cast("bigint").alias("version"))
    labelled = t.documents.join(t.labels, "doc_id").select(
        key, F.upper("source").alias("text"), F.col("quality").cast("bigint").alias("version")
    )
    german = t.documents.where("lang = 'de'").select(key, F.lower("source").alias("text"), F.lit(2).cast("bigint").alias("version"))
    return current, labelled.unionByName(german)


@query("chunk_table_upsert", ORACLES["chunk_upsert"])
def chunk_table_upsert(t: Tables) -> DataFrame:
    """The same through a stored table, of which only the touched buckets are rewritten."""
    current, incoming = _chunk_versions(t)
    path = f"{scratch_dir(t.spark)}/sextant-chunks-{uuid.uuid4().hex}"
    K.create_chunks(current, path)
    K.merge_chunks(t.spark, path, incoming)
    return K.read_chunks(t.spark, path)


@query(
    "exchange_text",
    """
    select q.conv_id, a.turn, '[CHAT]' || chr(10) || 'Question: ' || q.text || chr(10) || 'Answer: ' || a.text as text
    from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1
    where q.role = 'user' and a.role = 'assistant'
    """,
)
def exchange_text(t: Tables) -> DataFrame:
    pairs = X.pair_exchanges(t.conversations)
    text = X.exchange_text(F.col("question"), F.col("answer"), F.lit("chat"))
    return pairs.select("conv_id", "turn", text.alias("text"))


@query(
    "findings_rollup",
    """
    with f as (select conv_id * 1000 + turn as seq, role as agent, text as summary from conversations where length(text) > 40)
    select agent, count(*) as n_findings, max(seq) as last_seq, arg_max(summary, seq) as last_summary
    from f group by agent
    """,
)
def findings_rollup(t: Tables) -> DataFrame:
    findings = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.col("role").alias("agent"),
        F.col("text").alias("summary"),
        (F.length("text") > 40).alias("success"),
    )
    return X.findings_rollup(findings)


# -- retrieval --------------------------------------------------------------

_CENTROIDS_SQL = """
    dims as (select label, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i from embeddings),
    means as (select label, i, avg(x) as x from dims group by label, i),
    queries as (select label, list(x order by i) as q from means group by label)
"""


def _centroids(t: Tables) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    places = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = places.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return ordered.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("embedding"))


def _nearest_sql(distance: str) -> str:
    return (
        f"with {_CENTROIDS_SQL}, d as (select cast(label as bigint) as query_id, vec_id, {distance} as distance from queries, "
        "(select vec_id, cast(embedding as double[]) as e from embeddings)), "
        "r as (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from d) "
    )


_SQUARED = "list_sum(list_transform(list_zip(q, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_COSINE = "1 - list_cosine_similarity(q, e)"


@query(
    "knn_topk",
    _nearest_sql(_SQUARED) + "select query_id, vec_id, round(distance, 4) as distance, rank from r where rank <= 5",
)
def knn_topk(t: Tables) -> DataFrame:
    return N.nearest(t.embeddings, _centroids(t), 5).withColumn("distance", F.round("distance", 4))


@query(
    "knn_cosine",
    _nearest_sql(_COSINE) + "select query_id, vec_id, round(distance, 4) as distance, rank from r where rank <= 5",
)
def knn_cosine(t: Tables) -> DataFrame:
    return N.nearest(t.embeddings, _centroids(t), 5, "cosine").withColumn("distance", F.round("distance", 4))


@query("knn_visits")
def knn_visits(t: Tables) -> DataFrame:
    """How many cells of the index the search of each vector of the first label looked into."""
    asked = t.embeddings.where("label = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return N.PivotIndex(t.embeddings).search(asked, 5).visits


@query(
    "citations",
    _nearest_sql(_SQUARED)
    + "select query_id, rank, source as source_type, substr(text, 1, 200) || case when length(text) > 200 then '...' else '' end "
    "as excerpt from r join documents on doc_id = vec_id where rank <= 5",
)
def citations(t: Tables) -> DataFrame:
    hits = N.nearest(t.embeddings, _centroids(t), 5)
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("source_type"), "text")
    return X.citations(hits, texts)


# -- rules ------------------------------------------------------------------


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROUTE_SQL = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(trim(text)), {_quote(w)})" for w in words) + f" then '{label}'"
    for label, words in A.ROUTES
) + f" else '{A.UNLABELLED}' end"


@query("route_labels", f"select conv_id, turn, {_ROUTE_SQL} as route from conversations")
def route_labels(t: Tables) -> DataFrame:
    return A.route_questions(t.conversations, "text").select("conv_id", "turn", "route")


@query(
    "route_question_log",
    f"with {SQL_LOG_SQL} select event_id, {_ROUTE_SQL.replace('text', 'question')} as route from sql_log",
)
def route_question_log(t: Tables) -> DataFrame:
    return A.route_questions(sql_log(t.events), "question").select("event_id", "route")


_BARE = (
    r"regexp_replace(regexp_replace(regexp_replace(trim(statement), ';+$', ''), '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
)


@query(
    "sql_audit",
    f"with {SQL_LOG_SQL}, b as (select event_id, statement, {_BARE} as bare from sql_log), "
    "r as (select event_id, case when trim(statement) = '' then 'empty' "
    rf"when regexp_matches(bare, '(?i)\b({'|'.join(A.FORBIDDEN_WORDS)})\b') then 'forbidden_word' "
    r"when not regexp_matches(bare, '(?i)^\s*(select|with)\b') then 'not_select' "
    "when contains(bare, ';') then 'multiple_statements' else 'ok' end as reason from b) "
    "select event_id, reason, reason = 'ok' as ok from r",
)
def sql_audit(t: Tables) -> DataFrame:
    return A.audit_sql(sql_log(t.events), "statement").select("event_id", "reason", "ok")


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quote(pattern)})"


@query(
    "sql_coverage",
    f"with {SQL_LOG_SQL}, c as (select event_id, "
    + ", ".join(
        f"{_has(column, pattern)} as {name}"
        for name, column, pattern in (
            ("ranked", "question", A.ASKS_TOP),
            ("counted", "question", A.ASKS_COUNTED_TOP),
            ("grouped", "question", A.ASKS_PER_GROUP),
            ("bounded", "question", A.ASKS_THRESHOLD),
            ("share", "question", A.ASKS_SHARE),
            ("windowed", "answer", A.HAS_WINDOW),
            ("rank_filter", "answer", A.HAS_RANK_FILTER),
            ("limited", "answer", A.HAS_LIMIT),
            ("group_filter", "answer", A.HAS_GROUP_FILTER),
            ("total", "answer", A.HAS_TOTAL),
            ("shared", "answer", A.HAS_SHARE),
        )
    )
    + " from sql_log) select event_id, concat_ws(',', case when ranked and grouped and not windowed then 'needs_window' end, "
    "case when ranked and grouped and windowed and not rank_filter then 'needs_rank_filter' end, "
    "case when ranked and not grouped and counted and not windowed and not limited then 'needs_limit' end, "
    "case when bounded and not group_filter then 'needs_having' end, case when share and not total then 'needs_total' end, "
    "case when share and not shared then 'needs_share' end) as issues from c",
)
def sql_coverage(t: Tables) -> DataFrame:
    audited = A.audit_coverage(sql_log(t.events), "question", "answer")
    return audited.select("event_id", F.concat_ws(",", "issues").alias("issues"))
