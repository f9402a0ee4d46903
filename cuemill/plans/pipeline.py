"""From subtitle and text files to finished documents, as one lazy plan per task."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import base_name, collapse_repeats, natural_key, suffix
from cuemill.operators.cues import explode_lines, lines_as_cues, parse_cues, parse_cues_simply, running_text
from cuemill.operators.models import compared, decoded, model_map, transcribed, transcript_segments
from cuemill.operators.sentences import paragraphs, section_parts, sections_text, segment, timed_chunks
from cuemill.plans.jobs import DEFAULTS
from cuemill.providers import AudioDecoder, ModelSettings, TextModel, Transcriber
from cuemill.sinks import render
from cuemill.sinks.files import docx_content

TASKS = ("translate", "rewrite", "academic")


def merged_settings(given: dict[str, Any], config: dict[str, Any] | None = None, defaults: dict[str, Any] = DEFAULTS) -> dict[str, Any]:
    """Settings given on the call before those of a configuration before the defaults; None is not given."""
    out = dict(defaults)
    for source in (config or {}, given):
        out |= {key: value for key, value in source.items() if value is not None}
    return out


def cues_of_bodies(bodies: DataFrame) -> DataFrame:
    """Cues of subtitle files (source, body); plain .txt files give a cue per line."""
    plain = suffix(F.col("source")) == "txt"
    return parse_cues(explode_lines(bodies.where(~plain))).unionByName(lines_as_cues(explode_lines(bodies.where(plain))))


def texts_of_bodies(bodies: DataFrame) -> DataFrame:
    """source, text of any text files: .md, .markdown, .txt and .docx as they are, subtitles as running text."""
    whole = suffix(F.col("source")).isin("md", "markdown", "txt", "docx")
    running = running_text(parse_cues(explode_lines(bodies.where(~whole))))
    return bodies.where(whole).select("source", F.col("body").alias("text")).unionByName(running)


def documents(bodies: DataFrame, model: TextModel, task: str, *, language: str | None = None, chunk_length: int = DEFAULTS["chunk_length"], cite: bool = False, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """source, name, body, status, error of the finished document of each file.

    Where the model fails on a paragraph, the document lacks its answer, and has status ``error`` and the
    first error. ``cite`` keeps the times of subtitles: paragraphs are timestamped sections; files whose cues lack
    times are then taken as running text.
    """
    if task not in TASKS:
        raise ValueError(f"task must be one of {', '.join(TASKS)}")
    wanted = language or ("English" if task == "academic" else DEFAULTS["language"])
    if cite:
        cues = cues_of_bodies(bodies)
        timed = sections_text(timed_chunks(cues, chunk_length))
        rest = texts_of_bodies(bodies.join(timed.select("source"), "source", "left_anti"))
        paras = paragraphs(timed).unionByName(segment(rest, chunk_length))
    else:
        paras = segment(texts_of_bodies(bodies), chunk_length)
    parts = section_parts(paras)
    asked = model_map(parts, model, task, wanted, settings=settings)
    answered = asked.withColumn("answer", F.when(F.col("is_header") & (F.col("body") == ""), F.col("paragraph")).otherwise(F.col("answer")))
    if task == "translate":
        body = render.cited_bilingual_markdown(answered, wanted) if cite else render.bilingual_markdown(answered, wanted)
    else:
        body = render.plain_markdown(answered)
    ending = {"translate": "_bilingual.md", "rewrite": "_rewritten.md", "academic": "_academic.md"}[task]
    ended = answered.groupBy("source").agg(F.min_by("error", F.when(F.col("status") == "error", F.col("para_index"))).alias("error"))
    named = ended.join(body, "source", "left").withColumn("name", F.concat(base_name(F.col("source")), F.lit(ending)))
    return named.select("source", "name", F.coalesce("body", F.lit("")).alias("body"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")


def reports(bodies: DataFrame, finished: DataFrame) -> DataFrame:
    """source, name, body: a report of the changes from each file's text to its finished document."""
    pairs = texts_of_bodies(bodies).join(finished.select("source", F.col("body").alias("after")), "source")
    report = render.compare_report(compared(pairs, "text", "after").select("source", "diff"))
    return report.select("source", F.concat(base_name(F.col("source")), F.lit("_compare.md")).alias("name"), "body")


def formal_documents(bodies: DataFrame, model: TextModel, *, language: str | None = None, chunk_length: int = DEFAULTS["chunk_length"], settings: ModelSettings = ModelSettings()) -> DataFrame:
    """source, name, body, content, docx_name, status, error: texts in the formal register, as Markdown and
    as DOCX with a paragraph for each block."""
    finished = documents(bodies, model, "academic", language=language, chunk_length=chunk_length, settings=settings)
    return finished.withColumns({"content": docx_content(F.col("body")), "docx_name": F.regexp_replace("name", r"\.md$", ".docx")})


def media_documents(media: DataFrame, transcriber: Transcriber, model: TextModel, task: str, *, decoder: AudioDecoder | None = None, hint: str | None = None, language: str | None = None, chunk_length: int = DEFAULTS["chunk_length"], cite: bool = False, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """source, name, body, status, error of every media file (path, content): decoded, transcribed and made
    a document. A file whose decoding or transcription fails, or in which nothing is said, has no body;
    the others are finished all the same."""
    audio = decoded(media, decoder) if decoder else media.select("path", "content", F.lit(None).cast("string").alias("error"))
    heard = transcribed(audio, transcriber, hint).join(audio.select(F.col("path").alias("source"), F.col("error").alias("_earlier")), "source")
    bodies = render.transcript_vtt(transcript_segments(heard))
    finished = documents(bodies, model, task, language=language, chunk_length=chunk_length, cite=cite, settings=settings)
    joined = heard.select("source", F.coalesce("_earlier", "error").alias("_failed")).join(finished, "source", "left")
    error = F.coalesce("_failed", "error", F.when(F.col("status").isNull(), "nothing is said"))
    return joined.select("source", "name", "body", F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"))


def batch_document(finished: DataFrame) -> DataFrame:
    """folder, body: the documents of each folder's files in one, in natural order of their names."""
    done = finished.where("body is not null and body <> ''").withColumns({"folder": F.regexp_extract("source", r"^(.*?)[^/]*$", 1), "k": F.struct(natural_key(F.col("name")).alias("n"), F.col("source").alias("s"))})
    return render.batch_document(done.select("folder", "k", "name", F.col("body").alias("content")), "folder", "k")


def simple_documents(bodies: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The small pipeline for subtitles: their cues as CSV, and their sentences, without phrases said
    several times, as Markdown of ``n`` sentences a paragraph. Both have source and body."""
    cues = parse_cues_simply(explode_lines(bodies))
    text = running_text(cues).withColumn("text", collapse_repeats(F.col("text")))
    paras = segment(text, n).withColumn("answer", F.col("paragraph"))
    return render.cue_csv(cues, index=False), render.plain_markdown(paras)
