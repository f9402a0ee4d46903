"""A thin command line over the pipeline: rewrite, translate or academic, on a glob of files.

Without a model provider the stand-in model is used, which marks paragraphs and changes nothing.
Providers are named as ``package.module:attribute``, a class or an object.
"""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from pyspark.sql import functions as F

from cuemill.plans.jobs import DEFAULTS, misplaced_flags
from cuemill.plans.pipeline import documents, media_documents, merged_settings
from cuemill.providers import EchoModel, ModelSettings
from cuemill.session import local_session
from cuemill.sinks.files import unique_names, write_documents
from cuemill.sources.files import read_docx, read_subtitles

# What the command line asks for unless told otherwise, and the sizes of recognisers.
COMMAND_DEFAULTS = DEFAULTS | {"max_tokens": 130_000, "llm": "", "output_dir": ".", "multi_language": False, "transcribe_lang": "", "cite_timestamps": False}
RECOGNISERS = ["tiny", "base", "small", "medium", "large-v1", "large-v2", "large-v3", "large-v3-turbo", "turbo"]


def parser() -> argparse.ArgumentParser:
    """The arguments."""
    top = argparse.ArgumentParser(prog="cuemill", description=__doc__)
    tasks = top.add_subparsers(dest="task", required=True)
    for task, alias in (("rewrite", "rw"), ("translate", "tr"), ("academic", "ac")):
        sub = tasks.add_parser(task, aliases=[alias])
        sub.set_defaults(task=task)
        sub.add_argument("input", help="path or glob of text, subtitle or media files")
        sub.add_argument("--config", "-c", help="a YAML file with settings")
        sub.add_argument("--output-dir", "-o")
        sub.add_argument("--llm", help="model id, such as ollama/qwen3")
        sub.add_argument("--lang", "--language", "-l", dest="lang", help="language to write in")
        sub.add_argument("--chunk-length", "-cl", type=int, help="sentences a paragraph")
        sub.add_argument("--max-tokens", "-mt", type=int)
        sub.add_argument("--timeout", "-to", type=int, help="seconds")
        sub.add_argument("--temperature", "-tm", type=float)
        sub.add_argument("--cite-timestamps", action="store_true", default=None)
        sub.add_argument("--transcribe-model", "-tsm", choices=RECOGNISERS)
        sub.add_argument("--multi-language", "-m", action="store_true", default=None)
        sub.add_argument("--transcribe-lang", "-s")
        sub.add_argument("--provider", help="text model as package.module:attribute")
        sub.add_argument("--transcriber", help="transcriber as package.module:attribute; needed for media")
    return top


def provider(name: str) -> Any:
    """A provider by its name; classes are made objects."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def main(arguments: list[str] | None = None) -> int:
    """Runs a command; gives the number of documents written. Failures are printed, one a line."""
    given = vars(parser().parse_args(arguments))
    config = {}
    if given["config"]:
        import yaml

        with open(given["config"], encoding="utf-8") as text:
            config = yaml.safe_load(text) or {}
    settings = merged_settings({k: v for k, v in given.items() if k in COMMAND_DEFAULTS or k == "lang"}, config, COMMAND_DEFAULTS)
    spark = local_session()
    flags = spark.createDataFrame([(given["input"], settings["transcribe_model"], bool(settings["multi_language"]), settings["transcribe_lang"])], "path string, model string, several boolean, lang string")
    wrong = flags.select(misplaced_flags(F.col("path"), F.col("model"), F.col("several"), F.col("lang")).alias("e")).first().e
    if wrong:
        raise SystemExit(wrong)
    asked = ModelSettings(settings["llm"] or ModelSettings().model, settings["max_tokens"], settings["timeout"], settings["temperature"])
    model = provider(given["provider"]) if given["provider"] else EchoModel()
    options = {"language": settings.get("lang"), "chunk_length": settings["chunk_length"], "cite": bool(settings["cite_timestamps"]), "settings": asked}
    failed = None
    if given["transcriber"]:
        media = spark.read.format("binaryFile").load(given["input"]).select("path", "content")
        finished = media_documents(media, provider(given["transcriber"]), model, given["task"], hint=settings["transcribe_lang"] or None, **options)
    elif given["input"].endswith(".docx"):
        read = read_docx(spark, given["input"])
        failed = read.where("error is not null").select("source", "error")
        finished = documents(read.where("error is null").select("source", "body"), model, given["task"], **options)
    else:
        finished = documents(read_subtitles(spark, given["input"]), model, given["task"], **options)
    finished = finished.cache()
    written = write_documents(unique_names(finished.where("body is not null")), settings["output_dir"]).collect()
    for row in written:
        print(row.path, row.bytes)
    errors = finished.where("status = 'error'").select("source", "error")
    for row in (errors if failed is None else errors.unionByName(failed)).collect():
        print("failed:", row.source, row.error)
    return len(written)


if __name__ == "__main__":
    main()
