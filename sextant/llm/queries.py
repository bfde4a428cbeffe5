"""Registered queries of the operators in this folder; each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import quality_rules

    return quality_rules.scores(_table(spark, folder, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import secret_scan

    return secret_scan.scan(_table(spark, folder, "documents"))


@query("op2_bpe_codec")
def op2_bpe_codec(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    from sextant.llm import bpe

    return bpe.token_digests(_table(spark, folder, "documents"), vocabulary or _vocabulary("word_bpe_49k.json"))


@query("op9_minhash_near_dup")
def op9_minhash_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sextant.llm import near_dup

    found = near_dup.classes(_table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept")
    )


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import decontaminate

    return decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import hilbert

    return hilbert.assign(_table(spark, folder, "documents"))


#: Fixed values of the task.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op6_url_rules",
    r"""
    with rest as (
      select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
    parsed as (
      select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as k from rest),
    rules(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
      ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    fit as (
      select k, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
      from parsed join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by k)
    select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parsed left join fit using (k)
    """,
)
def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import url_rules

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(_table(spark, folder, "pages"), rules)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    from sextant.llm import token_files

    return token_files.round_trip(_table(spark, folder, "documents"), vocabulary or _vocabulary("byte_bpe_50k.json"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import languages

    return languages.predict(_table(spark, folder, "documents"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import licenses

    return licenses.scan(_table(spark, folder, "documents"))


@query(
    "op13_html_extraction",
    # The given pages mark their article and have headings and paragraphs in it; other pages are tested one by one.
    r"""
    with cut as (
      select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g') as a
      from pages),
    parts as (
      select page_id, url, list_transform(string_split_regex(a, '</?(p|h1)>'), lambda x: trim(regexp_replace(
        replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '&amp;?', chr(1), 'g'),
          '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) as b from cut),
    texts as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) as text from parts)
    select page_id, url, text, length(text) as n_chars from texts
    """,
)
def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import page_text

    return page_text.extract(_table(spark, folder, "pages"))


@query(
    "op11_turn_trie",
    r"""
    with own as (
      select conv_id, list(md5(md5(coalesce(role, '')) || coalesce(text, '')) order by turn nulls first) as ids,
        list(length(coalesce(text, '')) order by turn nulls first) as lens
      from conversations where conv_id is not null group by conv_id),
    bits as (
      select *, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))) as crc from own),
    heads as (select *, (xor(crc, 4294967295::bigint) % 6)::bigint as h from bits),
    rebuilt as (
      select a.conv_id, list_concat(coalesce(b.ids[1:a.h], []), a.ids[a.h + 1:]) as ids,
        list_concat(coalesce(b.lens[1:a.h], []), a.lens[a.h + 1:]) as lens
      from heads a left join own b on b.conv_id = a.conv_id - a.conv_id % 100),
    counted as (select *, len(ids) as n, generate_series(0, len(ids)) as depths from rebuilt),
    prefixes as (
      select conv_id, d, md5(array_to_string(ids[1:d], ',')) as key, md5(array_to_string(ids[1:d - 1], ',')) as above,
        case when d = 0 then 0 else lens[d] end as size, n = d as ends
      from (select *, unnest(depths) as d from counted)),
    nodes as (
      select d, key, min(above) as above, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
      from prefixes group by d, key),
    kids as (select d - 1 as d, above as key, count(*) as n_children from nodes where d > 0 group by all),
    sums as (
      select p.d, p.key, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens, count(*) filter (where k.n_children is null) as n_leaves
      from nodes n join prefixes p on p.conv_id = n.conv_id and p.d <= n.d left join kids k on k.d = n.d and k.key = n.key
      group by p.d, p.key)
    select n.conv_id, n.d::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
      s.n_leaves, s.saved_tokens, n.ends_sha256
    from nodes n join sums s on s.d = n.d and s.key = n.key left join kids k on k.d = n.d and k.key = n.key
      left join nodes q on q.d = n.d - 1 and q.key = n.above and n.d > 0
    """,
)
def op11_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import turn_trie

    return turn_trie.trie(_table(spark, folder, "conversations"))


@query(
    "op12_lexical_search",
    r"""
    with docs as (
      select row_number() over () as k, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
      from documents),
    sized as (select k, doc_id, ts, len(ts) as n from docs where len(ts) > 0),
    corpus as (select count(*) as docs, sum(n)::bigint as all_terms from sized),
    asked as (
      select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
      from benchmark),
    held as (
      select k, doc_id, n, t, count(*) as tf from (select k, doc_id, n, unnest(ts) as t from sized)
      where t in (select t from asked) group by all),
    weights as (
      select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
      from held, corpus group by t),
    scores as (
      select item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // all_terms))))::bigint as score
      from asked join held using (t) join weights using (t), corpus group by all)
    select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
    from scores where score > 0 qualify rank <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from sextant.llm import lexical_search

    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
