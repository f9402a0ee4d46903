"""The operators' inputs out of the test tables: subtitle bodies, segments, turns and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.times import milliseconds
from cuemill.session import table


def unique_cues(spark: SparkSession, folder: str) -> DataFrame:
    """source, cue_index, timestamps, content of every cue once."""
    cues = table(spark, folder, "cues").where("file_id is not null and cue_index is not null")
    return cues.groupBy(F.col("file_id").alias("source"), "cue_index").agg(F.min("timestamps").alias("timestamps"), F.min("content").alias("content"))


def _joined(cues: DataFrame, piece: Column, head: str) -> DataFrame:
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("cue_index", piece.alias("piece")))), lambda x: x["piece"])
    return cues.groupBy("source").agg(F.concat(F.lit(head), F.array_join(pieces, "\n")).alias("body"))


def subtitle_bodies(spark: SparkSession, folder: str, form: str) -> DataFrame:
    """source, body: each file's cues written as vtt, srt, dialogue, frames or mixed."""
    cues = unique_cues(spark, folder)
    number, times, content = F.col("cue_index").cast("string"), F.coalesce("timestamps", F.lit("")), F.coalesce("content", F.lit(""))
    vtt = F.concat(times, F.lit("\n"), content, F.lit("\n"))
    srt = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), times, F.lit("\n"), content, F.lit("\n"))
    dialogue = F.concat(F.lit("Dialogue: 0,"), times, F.lit(",,"), content)
    frames = F.concat(F.lit("{"), number, F.lit("}{"), (F.col("cue_index") + 1).cast("string"), F.lit("}"), content)
    kind = F.col("cue_index") % 7
    mixed = F.when(kind == 0, F.concat(F.lit("Dialogue: "), content)).when(kind == 1, number).when(kind == 2, content).when(kind == 3, frames).otherwise(F.when((F.col("source") % 3 == 0) & (F.col("cue_index") < 40), content).otherwise(vtt))
    piece, head = {"vtt": (vtt, "WEBVTT\n\n"), "srt": (srt, ""), "dialogue": (dialogue, "[Events]\n"), "frames": (frames, ""), "mixed": (mixed, "")}[form]
    return _joined(cues, piece, head)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """source (transcript_id), language, seg_no, speaker, start_ms, end_ms, text of every transcript once.
    Every other segment is in a form of Chinese, so that sources have several languages."""
    once = table(spark, folder, "transcripts").where("transcript_id is not null").dropDuplicates(["transcript_id"])
    rows = once.select(F.col("transcript_id").alias("source"), F.coalesce("detected_language", F.lit("und")).alias("language"), F.posexplode("segments").alias("pos", "s"))
    fourth = (F.col("pos") + 1) % 4
    return rows.select("source", F.when(fourth == 0, "zh-CN").when(fourth == 2, "zh").otherwise(F.col("language")).alias("language"), (F.col("pos") + 1).cast("bigint").alias("seg_no"), F.concat(F.lit("S"), ((F.col("pos") + 1) % 3).cast("string")).alias("speaker"), milliseconds(F.col("s.start_s")).alias("start_ms"), milliseconds(F.col("s.end_s")).alias("end_ms"), F.col("s.text").alias("text"))


def rewrite_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """source (file_id), para_index (pair_id), paragraph, answer of every rewriting once."""
    rows = table(spark, folder, "para_rewrites").where("pair_id is not null and file_id is not null and text is not null")
    return rows.groupBy(F.col("file_id").alias("source"), F.col("pair_id").alias("para_index")).agg(F.min("text").alias("paragraph"), F.min("rewritten").alias("answer"))


def translation_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """source (file_id), para_index (pair_id), paragraph, target of every text to translate once."""
    rows = table(spark, folder, "translations").where("pair_id is not null and file_id is not null and english_text is not null")
    return rows.groupBy(F.col("file_id").alias("source"), F.col("pair_id").alias("para_index")).agg(F.min("english_text").alias("paragraph"), F.min("translate_language").alias("target"))


def channel_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of the files of a channel with eight neighbouring ids: inputs in the order of ids, some with
    segments and some with a recogniser of their own, which may be null."""
    files = table(spark, folder, "files").where("file_id is not null").dropDuplicates(["file_id"])
    n = F.col("file_id")
    segment = lambda a, b, title, wav: F.struct(F.lit(a).alias("start_time"), F.lit(b).alias("end_time"), title.alias("title"), wav.alias("output_wav"))
    none = F.lit(None).cast("string")
    two = F.array(segment(" 00:00:05", "00:01:00 ", none, none), segment("00:01:00", "00:02:00", F.concat(F.lit("part of "), n.cast("string")), F.lit("part.wav")))
    item = F.struct(
        n.alias("n"), F.col("file_path").alias("input"), F.when(n % 4 == 1, F.concat(F.lit("File "), n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, F.create_map(F.lit("transcribe_model"), F.col("model_size"), F.lit("chunk_length"), F.lit("5"))).alias("settings"),
        F.when(n % 2 == 0, two).otherwise(F.array().cast("array<struct<start_time: string, end_time: string, title: string, output_wav: string>>")).alias("segments"),
    )
    job = (F.coalesce("channel_id", F.lit(-1)) * 1_000_000 + F.floor(n / 8)).cast("bigint")
    # A map cannot be sorted by: inputs are sorted by their number alone.
    ordered = F.array_sort(F.collect_list(item), lambda a, b: (a["n"] - b["n"]).cast("int"))
    grouped = files.groupBy(job.alias("job_id")).agg(F.transform(ordered, lambda x: x.dropFields("n")).alias("inputs"), F.max("channel_id").alias("c"))
    settings = F.when(F.col("c") % 2 == 0, F.create_map(F.lit("output_dir"), F.lit("./out"), F.lit("transcribe_model"), F.lit("base"))).otherwise(F.create_map(F.lit("output_dir"), F.lit("./out")))
    return grouped.select("job_id", settings.alias("settings"), "inputs")


def text_media(spark: SparkSession, folder: str) -> DataFrame:
    """path, content: the documents' texts as the audio that the stand-ins for media understand."""
    return table(spark, folder, "documents").select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".wav").otherwise(".mp3")).alias("path"), F.col("text").cast("binary").alias("content"))
