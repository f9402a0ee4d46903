"""Speakers' turns, languages' segments and clips on a time line. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def turns_by_speaker(turns: DataFrame) -> DataFrame:
    """source, speaker, speaker_order, turns: each speaker's turns in time, speakers as first heard.

    Input: source, speaker, turn_no, start_ms, end_ms.
    """
    grouped = turns.groupBy("source", "speaker").agg(F.min("turn_no").alias("first_turn"), F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("turns"))
    return grouped.withColumn("speaker_order", F.row_number().over(Window.partitionBy("source").orderBy("first_turn", "speaker")).cast("bigint")).drop("first_turn")


def rebased(turns: DataFrame) -> DataFrame:
    """Adds local_start_ms and local_end_ms: where a turn lies in the joined turns of its speaker."""
    before = Window.partitionBy("source", "speaker").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    start = F.coalesce(F.sum(length).over(before), F.lit(0).cast("bigint"))
    return turns.withColumn("local_start_ms", start).withColumn("local_end_ms", start + length)


def segments_by_language(segments: DataFrame) -> DataFrame:
    """source, language, segments, n_segments: segments by the language heard, in the order of
    speakers and of each speaker's segments. Input: source, language, speaker_order, seg_no, start_ms, end_ms, text."""
    item = F.struct("speaker_order", "seg_no", "start_ms", "end_ms", "text")
    return segments.groupBy("source", "language").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["start_ms"], x["end_ms"], x["text"])).alias("segments"), F.count(F.lit(1)).alias("n_segments"))


def clipped(segments: DataFrame, begin_ms: int, end_ms: int) -> DataFrame:
    """Segments that overlap [begin_ms, end_ms), cut to it."""
    inside = segments.where((F.col("end_ms") > begin_ms) & (F.col("start_ms") < end_ms))
    return inside.withColumns({"start_ms": F.greatest(F.col("start_ms"), F.lit(begin_ms).cast("bigint")), "end_ms": F.least(F.col("end_ms"), F.lit(end_ms).cast("bigint"))})
