"""Chunking, exchange texts, chunk tables, findings and citations of retrieved vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.columns import quoted
from sextant.functions.chunking import overlapping_chunks
from sextant.operators.joins import small_side
from sextant.scratch import materialize

# -- chunks -----------------------------------------------------------------


def chunk_documents(
    df: DataFrame, doc_id: str, text: str, source: Column | None = None, limit: int = 500, overlap: int = 50
) -> DataFrame:
    """(id, doc_id, source_type, chunk_index, text) of whole texts.

    Documents are independent, so the split runs where they lie, with no
    shuffle. The id covers the document, so equal texts do not collide.
    """
    source = source if source is not None else F.lit("document")
    rows = df.select(quoted(doc_id).alias("doc_id"), source.alias("source_type"), quoted(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [overlapping_chunks(t, limit, overlap) for t in batch.pop("text")]
            batch["chunk_index"] = [list(range(len(p))) for p in parts]
            batch["text"] = parts
            yield batch[batch["text"].str.len() > 0].explode(["chunk_index", "text"])

    chunks = rows.mapInPandas(split, f"doc_id {kind}, source_type string, chunk_index bigint, text string")
    key = F.concat_ws(
        ":", "source_type", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.substring("text", 1, 50)
    )
    return chunks.select(
        F.concat_ws("_", "source_type", F.substring(F.md5(key.cast("binary")), 1, 12)).alias("id"),
        "doc_id",
        "source_type",
        "chunk_index",
        "text",
    )


def upsert_chunks(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Union of two chunk tables in which an incoming row replaces the one with its id.

    Within the incoming rows the highest ``version`` wins, so every row needs one.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = W.partitionBy(key).orderBy(F.desc("_new"), F.desc("version"))
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_new")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count("*").alias("n_chunks"))


def exchange_text(question: Column, answer: Column, source_type: Column, details: Column | None = None) -> Column:
    """Text under which an exchange is indexed."""
    lines = [
        F.concat(F.lit("["), F.upper(source_type), F.lit("]")),
        F.concat(F.lit("Question: "), question),
        F.concat(F.lit("Answer: "), answer),
    ]
    if details is not None:
        lines.append(F.when(details != "", F.concat(F.lit("Details: "), details)))
    return F.concat_ws("\n", *lines)


def pair_exchanges(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, from (conv_id, turn, role, text).

    Joined on (conversation, turn), a key no conversation of any length makes hot.
    """
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Per agent: number of successful findings and the last one, from (seq, agent, summary, success)."""
    return (
        findings.where("success")
        .groupBy("agent")
        .agg(
            F.count("*").alias("n_findings"),
            F.max("seq").alias("last_seq"),
            F.max_by("summary", F.struct("seq", "summary")).alias("last_summary"),
        )
    )


# -- retrieval --------------------------------------------------------------

def citations(hits: DataFrame, texts: DataFrame, length: int = 200) -> DataFrame:
    """Rank, source and excerpt per hit, from hits and (vec_id, source_type, text)."""
    text = F.col("text")
    found = small_side(materialize(hits, "hits"))  # k rows per query
    excerpt = F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, "...").otherwise(""))
    return texts.join(found, "vec_id").select("query_id", "rank", "source_type", excerpt.alias("excerpt"))
