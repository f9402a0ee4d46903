"""Jobs: their expansion to work items, the routing of inputs, and results as rows.

A failure is a row with status and error, never a text that looks like a result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import base_name, input_kind, strip, suffix
from cuemill.sinks.render import job_document

# Default settings of a job.
DEFAULTS = {"chunk_length": 20, "max_tokens": 50_000, "timeout": 3600, "temperature": 0.1, "transcribe_model": "large-v3", "language": "Chinese"}

SEGMENT = "struct<start_time: string, end_time: string, title: string, output_wav: string>"
INPUT = f"struct<input: string, title: string, settings: map<string, string>, segments: array<{SEGMENT}>>"
JOB = f"job_id bigint, settings map<string, string>, inputs array<{INPUT}>"


def _text(value: object) -> str | None:
    """A setting as a string: strings as they are, all else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def load_jobs(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Jobs out of YAML texts: job_id, settings, inputs. A job with ``input`` has that one input; segments
    that are no mappings are left out. All other keys of jobs and inputs are kept as settings.
    Configurations are small and are read on the driver."""
    import yaml

    def settings(mapping: dict) -> dict[str, str | None]:
        return {str(k): _text(v) for k, v in mapping.items() if k not in ("input", "inputs", "segments", "title")}

    def segment(given: dict) -> tuple:
        return tuple(_text(given.get(k)) for k in ("start_time", "end_time", "title", "output_wav"))

    rows = []
    for i, text in enumerate(texts):
        job = (yaml.safe_load(text) if text else None) or {}
        inputs = [{"input": job["input"], "segments": job.get("segments")}] if job.get("input") else []
        inputs += [x for x in job.get("inputs") or [] if isinstance(x, dict)]
        rows.append((i, settings(job), [(x.get("input"), x.get("title"), settings(x), [segment(s) for s in x.get("segments") or [] if isinstance(s, dict)]) for x in inputs]))
    return spark.createDataFrame(rows, JOB)


def expand_jobs(jobs: DataFrame) -> DataFrame:
    """One row per work item: job_id, input_no, segment_no (null for a whole input), input, start_time,
    end_time, output_wav, title, settings, transcribe_model, output_dir. Settings of an input come before
    those of its job, empty ones too."""
    none = F.create_map().cast("map<string,string>")
    inputs = jobs.select("job_id", F.coalesce("settings", none).alias("_job"), F.posexplode("inputs").alias("input_no", "i")).withColumn("_input", F.coalesce("i.settings", none))
    merged = F.map_zip_with("_job", "_input", lambda k, of_job, of_input: F.when(F.map_contains_key(F.col("_input"), k), of_input).otherwise(of_job))
    items = inputs.select("job_id", merged.alias("settings"), F.col("input_no").cast("bigint").alias("input_no"), "i", F.posexplode_outer("i.segments").alias("segment_no", "s"))
    return items.select(
        "job_id", "input_no", F.col("segment_no").cast("bigint").alias("segment_no"), F.col("i.input").alias("input"), strip(F.col("s.start_time")).alias("start_time"), strip(F.col("s.end_time")).alias("end_time"), F.col("s.output_wav").alias("output_wav"),
        default_title(F.coalesce("s.title", F.when(F.col("segment_no").isNull(), F.col("i.title"))), F.col("segment_no"), F.col("s.start_time"), F.col("s.end_time"), F.col("i.input")).alias("title"),
        "settings", F.coalesce(F.col("settings")["transcribe_model"], F.lit(DEFAULTS["transcribe_model"])).alias("transcribe_model"), F.col("settings")["output_dir"].alias("output_dir"),
    )


def job_documents(items: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, body: the kept results of each job's work items under their titles, in order, in one document.

    ``results`` has job_id, input_no, segment_no, text and base_name of each item that was run.
    """
    keys = ["job_id", "input_no", F.coalesce("segment_no", F.lit(-1).cast("bigint")).alias("_s")]
    kept = kept_results(results).select(*keys, F.col("text").alias("content"))
    joined = items.select(*keys, "title").join(kept, ["job_id", "input_no", "_s"])
    return job_document(joined.select("job_id", F.struct("input_no", "_s").alias("ordinal"), "title", "content"), "job_id")


def default_title(title: Column, segment_no: Column, start: Column, end: Column, path: Column) -> Column:
    """A title, else the number of a segment that has a range, else the input's base name."""
    return F.coalesce(title, F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("Segment "), (segment_no + 1).cast("string"))), base_name(path))


def clip_name(path: Column, start: Column, end: Column, output_wav: Column) -> Column:
    """The name of the audio cut from an input; a given name counts only with a range."""
    ranged = start.isNotNull() & end.isNotNull()
    named = F.regexp_replace(output_wav, r"\.[^./]*$", "")
    return F.when(ranged & (F.coalesce(output_wav, F.lit("")) != ""), F.concat(named, F.lit(".wav"))).when(ranged, F.concat(base_name(path), F.lit("_"), start, F.lit("-"), end, F.lit(".wav"))).otherwise(F.concat(base_name(path), F.lit(".wav")))


def kept_results(results: DataFrame) -> DataFrame:
    """Results that have a text and a base name."""
    return results.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("base_name", F.lit("")) != ""))


def chosen_input(path: Column, url: Column) -> Column:
    """What is read where a file and an address are given: the address, unless it is blank."""
    return F.when(strip(F.coalesce(url, F.lit(""))) != "", strip(url)).otherwise(path)


def routed(inputs: DataFrame, path: str = "path", subcommand: str | None = None) -> DataFrame:
    """Adds kind, route and error to inputs: media are transcribed first; with a subcommand all go to
    it; without one transcripts go by language and .docx, .txt and .md to the formal register."""
    kind = input_kind(F.col(path))
    direct = F.lit(subcommand) if subcommand else F.when(kind.isin("url", "media"), "transcript").when(suffix(F.col(path)).isin("docx", "txt", "md"), "academic")
    route = F.when(F.coalesce(F.col(path), F.lit("")) == "", F.lit(None).cast("string")).when(kind != "unsupported", direct)
    error = F.when(F.coalesce(F.col(path), F.lit("")) == "", "no input").when(kind == "unsupported", "unsupported input").when(route.isNull(), "no route for this type")
    return inputs.withColumns({"kind": kind, "route": route, "error": error})


def misplaced_flags(path: Column, transcribe_model: Column, multi_language: Column, transcribe_lang: Column) -> Column:
    """The options of transcription that are given for an input that is neither media nor an address, as an
    error; null if there are none."""
    given = F.array_compact(
        F.array(
            F.when(F.coalesce(transcribe_model, F.lit("")).isin("", DEFAULTS["transcribe_model"]), None).otherwise("--transcribe-model"),
            F.when(F.coalesce(multi_language, F.lit(False)), "--multi-language"),
            F.when(F.coalesce(transcribe_lang, F.lit("")) != "", "--transcribe-lang"),
        )
    )
    spoken = F.coalesce(input_kind(path).isin("url", "media"), F.lit(False))
    return F.when(~spoken & (F.size(given) > 0), F.concat(F.lit("only for media and addresses: "), F.array_join(given, ", ")))


def transcript_route(detected: Column, target: Column) -> Column:
    """rewrite for Chinese that is wanted in Chinese, else translate."""
    return F.when((detected == "zh") & (F.lower(target) == "chinese"), "rewrite").otherwise("translate")
