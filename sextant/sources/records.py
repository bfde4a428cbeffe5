"""Records of CSV files whose quoted cells hold line breaks, read by many tasks a file.

Whether a line starts inside a quoted cell depends on all lines before it. A
line, and so a whole split of a file, is a function of two states (outside or
inside a cell) and such functions can be chained. One pass finds the function
of each split, the starts of all splits follow from these few rows, and a
second pass joins the lines of each record. A record that crosses splits comes
as fragments, which alone are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.scratch import materialize

#: What is left of a quoted cell up to its closing quote; doubled quotes are text.
_CELL = re.compile(r'(?:[^"]|"")*+("?)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line. A quote opens a cell only as its first character."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            cell = _CELL.match(line, at if inside else at + 1)
            if not cell[1]:
                return True
            at, inside = cell.end(), False
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each split of each file, in order within their task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each split ends if it starts outside or inside a cell."""
    here, states = None, [False, True]
    for batch in batches:
        done = []
        for file, block, line in zip(batch["file"], batch["block"], batch["value"]):
            if (file, block) != here:
                if here is not None:
                    done.append((*here, *states))
                here, states = (file, block), [False, True]
            if '"' in line:
                states = [ends_inside(line, s) for s in states]
        yield pd.DataFrame(done, columns=["file", "block", "outside", "inside"]).astype({"outside": bool, "inside": bool})
    if here is not None:
        yield pd.DataFrame([(*here, *states)], columns=["file", "block", "outside", "inside"])


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of a file, a row per split."""
    state, out = False, []
    for file, block, outside, inside in splits.sort_values("block").itertuples(index=False):
        out.append((file, block, state))
        state = inside if state else outside
    return pd.DataFrame(out, columns=["file", "block", "open"])


def _join_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records, and fragments (place 0 ends what an earlier split opened, 1 is open at the end of its split)."""
    columns = ["file", "block", "place", "opens", "head", "text"]
    kinds = {"block": "int64", "place": "Int32", "opens": bool, "head": bool}
    here, open_, begun, held, heading = None, False, True, [], False

    def rest() -> list[tuple]:
        if not held:
            return []
        return [(*here, 1 if begun else 0, begun, heading and begun, "\n".join(held))]

    for batch in batches:
        out = []
        for file, block, start, line in zip(batch["file"], batch["block"], batch["open"], batch["value"]):
            if (file, block) != here:
                out += rest()
                # Lines that continue a record of an earlier split are a fragment even if they close it.
                here, open_, begun, held, heading = (file, block), bool(start), not start, [], block == 0
            held.append(line)
            if '"' in line:
                open_ = ends_inside(line, open_)
            if not open_:
                text = "\n".join(held)
                out.append((*here, None if begun else 0, begun, heading, text))
                heading = heading and not text.strip()
                begun, held = True, []
        yield pd.DataFrame(out, columns=columns, dtype=object).astype(kinds)
    if here is not None:
        yield pd.DataFrame(rest(), columns=columns, dtype=object).astype(kinds)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, text) of every record that is not blank, without a carriage return before line breaks that have one.

    ``head`` marks the first record of a file.
    """
    lines = _lines(spark, path)
    moves = lines.mapInPandas(_transitions, "file string, block long, outside boolean, inside boolean")
    moves = materialize(moves, "splits")
    starts = moves.groupBy("file").applyInPandas(_starts, "file string, block long, open boolean").where("open")
    # One narrow row at most for a split; a broadcast keeps the lines of a split where they are, in order.
    placed = lines.join(F.broadcast(materialize(starts, "split-starts")), ["file", "block"], "left")
    placed = placed.withColumn("open", F.coalesce("open", F.lit(False)))
    parts = placed.mapInPandas(
        _join_lines, "file string, block long, place int, opens boolean, head boolean, text string"
    )
    parts = materialize(parts, "records")
    pieces = parts.where("place is not null")
    order = W.partitionBy("file").orderBy("block", "place")
    numbered = pieces.withColumn("no", F.sum(F.col("opens").cast("int")).over(order))
    in_order = F.sort_array(F.collect_list(F.struct("block", "place", "text")))
    joined = numbered.groupBy("file", "no").agg(
        F.bool_or("head").alias("head"), F.concat_ws("\n", F.transform(in_order, lambda x: x.text)).alias("text")
    )
    records = parts.where("place is null").select("file", "head", "text").unionByName(joined.select("file", "head", "text"))
    # Where lines end in both characters, so do the breaks inside cells.
    plain = F.when(F.endswith("text", F.lit("\r")), F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\r$", ""))
    return records.withColumn("text", F.coalesce(plain, "text")).where(F.trim("text") != "")
