"""Cue tables from the lines of subtitle files.

Input is one row per line: source, line_no, line. A file's lines are one window partition, because a
cue's extent depends on all lines before it; files are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuemill.functions.text import ALL_NEWLINES, CUE_TIMES, CUE_TIMES_LOOSE, FRAME_COUNTS, NEWLINES, lines_of, strip


def explode_lines(texts: DataFrame, source: str = "source", body: str = "body", *, in_memory: bool = False) -> DataFrame:
    """source, line_no (from 0), line of every line; null bodies have none.

    ``in_memory`` also breaks at the further separators that a string in memory is split at.
    """
    pattern = ALL_NEWLINES if in_memory else NEWLINES
    numbered = texts.where(F.col(body).isNotNull()).select(F.col(source).alias("source"), F.posexplode(lines_of(F.col(body), pattern)).alias("line_no", "line"))
    return numbered.withColumn("line_no", F.col("line_no").cast("bigint"))


def _classes(lines: DataFrame, times: str) -> DataFrame:
    text = strip(F.col("line"))
    arrow = F.col("text").contains("-->")
    return lines.withColumn("text", text).withColumns(
        {"loose": arrow, "strict": arrow & F.col("text").rlike(times), "talk": ~arrow & (F.col("text").contains("Dialogue:") | F.col("text").rlike(FRAME_COUNTS)), "number": F.col("text").rlike(r"^[\p{Nd}\p{No}]+$")}
    )


def _collect(members: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("text") != "") & ~F.col("starts"), F.struct("line_no", "text")))), lambda x: x["text"]), " ")
    cues = members.groupBy("source", "cue").agg(F.max(F.when(F.col("starts"), F.col("text"))).alias("timestamps"), text.alias("content"))
    return cues.select("source", (F.col("cue") - 1).cast("bigint").alias("cue_index"), "timestamps", "content")


def parse_cues(lines: DataFrame) -> DataFrame:
    """source, cue_index, timestamps, content: cues of VTT, SRT, ASS and frame-counted files.

    A line with an arrow, a dialogue line or a frame-counted line starts the first cue; once an arrow
    has been seen, only lines with full times start another and all else is content, numbers
    included. Before that, a line of digits ends a cue and the next header starts one. Times are kept
    as written; content is the stripped lines joined by a space. Files without cues give no rows.
    """
    so_far = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = Window.partitionBy("source")
    step = _classes(lines, CUE_TIMES).withColumn("blk", F.sum(F.col("number").cast("int")).over(so_far))
    step = step.withColumn("head", F.min(F.when(F.col("loose") | F.col("talk"), F.col("line_no"))).over(Window.partitionBy("source", "blk")))
    step = step.withColumn("first", F.min(F.when(F.col("loose") & (F.col("line_no") == F.col("head")), F.col("line_no"))).over(file))
    no, head, first = F.col("line_no"), F.col("head"), F.col("first")
    starts = F.coalesce((F.col("talk") & (no == head) & (first.isNull() | (no < first))) | (no == first) | ((no > first) & F.col("strict")), F.lit(False))
    step = step.withColumn("starts", starts).withColumn("cue", F.sum(F.col("starts").cast("int")).over(so_far)).where("cue > 0")
    step = step.withColumn("start_blk", F.max(F.when(F.col("starts"), F.col("blk"))).over(Window.partitionBy("source", "cue")))
    return _collect(step.where(F.col("starts") | F.coalesce(no > first, F.lit(False)) | (F.col("blk") == F.col("start_blk"))))


def parse_cues_simply(lines: DataFrame) -> DataFrame:
    """Like ``parse_cues`` for VTT and SRT only: any space may surround the arrow, and a line of digits
    ends a cue, after which lines are skipped up to the next line with an arrow."""
    so_far = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = _classes(lines, CUE_TIMES_LOOSE).withColumn("blk", F.sum(F.col("number").cast("int")).over(so_far))
    step = step.withColumn("head", F.min(F.when(F.col("loose"), F.col("line_no"))).over(Window.partitionBy("source", "blk")))
    step = step.withColumn("starts", F.coalesce(F.col("strict") | (F.col("loose") & (F.col("line_no") == F.col("head"))), F.lit(False)))
    step = step.withColumn("cue", F.sum(F.col("starts").cast("int")).over(so_far)).where("cue > 0")
    step = step.withColumn("start_blk", F.max(F.when(F.col("starts"), F.col("blk"))).over(Window.partitionBy("source", "cue")))
    return _collect(step.where(F.col("starts") | (F.col("blk") == F.col("start_blk"))))


def lines_as_cues(lines: DataFrame, *, from_file: bool = True) -> DataFrame:
    """Every line of a plain text as a cue without times; lines read from a file keep their newline."""
    return lines.select("source", F.col("line_no").alias("cue_index"), F.lit("").alias("timestamps"), (F.concat("line", F.lit("\n")) if from_file else F.col("line")).alias("content"))


def running_text(cues: DataFrame, separator: str = "。") -> DataFrame:
    """source, text: a file's contents in order, joined."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("cue_index", "content"))), lambda x: x["content"])
    return cues.where("content is not null").groupBy("source").agg(F.array_join(pieces, separator).alias("text"))


def untimed_files(cues: DataFrame) -> DataFrame:
    """source, untimed: whether a file has a cue with null or empty times."""
    return cues.groupBy("source").agg(F.bool_or(F.col("timestamps").isNull() | (F.col("timestamps") == "")).alias("untimed"))


def language_sample(cues: DataFrame, n: int = 20) -> DataFrame:
    """source, sample, blank: the first ``n`` cues joined by spaces, from which a language is guessed."""
    joined = running_text(cues.where(F.col("cue_index") < n), " ").withColumnRenamed("text", "sample")
    return joined.withColumn("blank", strip(F.col("sample")) == "")
