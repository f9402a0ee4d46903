"""Documents out of tables: VTT, CSV lines and Markdown. Everything is one aggregate per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.times import clock


def _ordered(order: list[str], value: Column, separator: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(*order, value.alias("_piece"))))
    return F.array_join(F.transform(pieces, lambda x: x["_piece"]), separator)


def _times() -> Column:
    return F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")))


def transcript_vtt(segments: DataFrame) -> DataFrame:
    """source, body: a transcript as VTT. As a space joins the pieces, text lines end in one and no
    blank line parts cues. Input: source, seg_no, start_ms, end_ms, text."""
    body = F.concat(F.lit("WEBVTT\n "), _ordered(["seg_no"], F.concat(F.lit("\n"), _times(), F.lit("\n"), F.coalesce("text", F.lit(""))), " "))
    return segments.groupBy("source").agg(F.regexp_replace(body, r"^WEBVTT\n \n", "WEBVTT\n \n").alias("body"))


def language_vtt(segments: DataFrame, *, tagged: bool = True) -> DataFrame:
    """source, language, name, body: a VTT per language, each cue tagged with it; or, untagged, one
    body per source. Input: source, language, seg_no, start_ms, end_ms, text."""
    if tagged:
        piece = F.concat(F.lit("\n"), _times(), F.lit("\n["), F.col("language"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
        grouped = segments.groupBy("source", "language").agg(F.concat(F.lit("WEBVTT\n"), _ordered(["seg_no"], piece, "\n")).alias("body"))
        return grouped.withColumn("name", F.concat(F.col("source").cast("string"), F.lit("_"), F.col("language"), F.lit(".vtt")))
    piece = F.concat(F.lit("\n"), _times(), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return segments.groupBy("source").agg(F.concat(F.lit("WEBVTT\n"), _ordered(["language", "seg_no"], piece, "\n")).alias("body"))


def _csv(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(F.coalesce(value, F.lit("")))


def cue_csv(cues: DataFrame, *, index: bool = True) -> DataFrame:
    """source, body: a file's cues as CSV with a header, with or without the index column."""
    row = F.concat(_csv(F.col("timestamps")), F.lit(","), _csv(F.col("content")))
    if index:
        row = F.concat(F.col("cue_index").cast("string"), F.lit(","), row)
    header = ",Timestamps,Content\n" if index else "Timestamps,Content\n"
    return cues.groupBy("source").agg(F.concat(F.lit(header), _ordered(["cue_index"], row, "\n"), F.lit("\n")).alias("body"))


def bilingual_markdown(pairs: DataFrame, language: str, *, title: str = "English") -> DataFrame:
    """source, body: each paragraph with its answer under headings. Input: source, para_index, paragraph, answer."""
    piece = F.concat(F.lit(f"# {title}\n"), F.col("paragraph"), F.lit(f"\n\n# {language}\n"), F.coalesce("answer", F.lit("")), F.lit("\n\n---\n"))
    return pairs.groupBy("source").agg(_ordered(["para_index"], piece, "\n").alias("body"))


def cited_bilingual_markdown(sections: DataFrame, language: str) -> DataFrame:
    """source, body: like ``bilingual_markdown`` for timestamped sections: headers stand alone.
    Input: source, para_index, is_header, paragraph, answer."""
    piece = F.when(F.col("is_header"), F.concat(F.col("paragraph"), F.lit("\n\n---\n"))).otherwise(F.concat(F.lit("# Original\n"), F.col("paragraph"), F.lit(f"\n\n# {language}\n"), F.coalesce("answer", F.lit("")), F.lit("\n\n---\n")))
    return sections.groupBy("source").agg(_ordered(["para_index"], piece, "\n").alias("body"))


def plain_markdown(answers: DataFrame) -> DataFrame:
    """source, body: answers as paragraphs. Input: source, para_index, answer."""
    return answers.where("answer is not null").groupBy("source").agg(_ordered(["para_index"], F.col("answer"), "\n\n").alias("body"))


# Heading and legend of the report of a rewriting.
COMPARE_HEAD = """# Academic Writing Comparison

This document shows the changes made during academic rewriting.

## Legend:
- **Red text with strikethrough**: Deleted content
- **Green text**: Added content

## Comparison:

"""


def compare_report(texts: DataFrame) -> DataFrame:
    """source, body: a report of changes with its legend. Input: source, diff."""
    return texts.select("source", F.concat(F.lit(COMPARE_HEAD), F.coalesce("diff", F.lit(""))).alias("body"))


def documents_report(pairs: DataFrame) -> DataFrame:
    """source, body: a report of what changed from one document to another. Input: source, original,
    modified (their names), date (a timestamp), diff."""
    name = lambda title, value: F.concat(F.lit(f"**{title}:** "), F.coalesce(value, F.lit("")), F.lit("\n"))
    body = F.concat(F.lit("# Document Comparison\n\n"), name("Original", F.col("original")), name("Modified", F.col("modified")), name("Date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")), F.lit("\n## Changes\n\n"), F.coalesce("diff", F.lit("")))
    return pairs.select("source", body.alias("body"))


def job_document(items: DataFrame, key: str) -> DataFrame:
    """``key``, body: titled contents with a rule between them. Input: key, ordinal, title, content."""
    return items.groupBy(key).agg(_ordered(["ordinal"], F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("content")), "\n---\n\n").alias("body"))


def batch_document(items: DataFrame, key: str, sort_key: str) -> DataFrame:
    """``key``, body: files under their names with a rule after each, in the order of ``sort_key``.
    Input: key, sort_key, name, content."""
    piece = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n\n"))
    return items.groupBy(key).agg(_ordered([sort_key], piece, "").alias("body"))


def plain_batch_document(items: DataFrame, key: str, sort_key: str) -> DataFrame:
    """``key``, body: files under their names in the order of ``sort_key``, without rules; a file without
    content has its name only. Input: key, sort_key, name, content."""
    content = F.when(F.coalesce("content", F.lit("")) != "", F.concat("content", F.lit("\n\n"))).otherwise("")
    return items.groupBy(key).agg(_ordered([sort_key], F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), content), "").alias("body"))
