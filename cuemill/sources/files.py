"""Files as tables: texts, subtitles, DOCX and media, by glob or folder."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import is_batch_media, natural_key

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_subtitles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, body of whole files; bytes that are no UTF-8 become U+FFFD, a byte order mark goes."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(F.col("path").alias("source"), F.regexp_replace(text, r"^\x{feff}", "").alias("body"))


def read_texts(spark: SparkSession, paths: str | list[str], *, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """source, body, error of whole text files as they are, empty ones too; a file that is no UTF-8 has an
    error and no body."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    found = reader.load(paths)
    rows = found.select(F.col("path").alias("source"), F.when(valid, text).alias("body"), F.when(~valid, "not UTF-8").alias("error"))
    # Files without bytes are listed, on the driver as all files are, but not read.
    one_slash = lambda name: F.regexp_replace(name, "^file:/+", "file:/")
    listed = spark.createDataFrame([(name,) for name in found.inputFiles()], "name string").select(one_slash("name").alias("name"))
    empty = listed.join(found.select(one_slash(F.col("_metadata.file_path")).alias("name")), "name", "left_anti")
    path = F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))
    return rows.unionByName(empty.select(path.alias("source"), F.lit("").alias("body"), F.lit(None).cast("string").alias("error")))


def read_finished(spark: SparkSession, folder: str) -> DataFrame:
    """source, body, error of a folder's finished documents: rewritten and bilingual ones."""
    return read_texts(spark, folder, glob="*_{rewritten,bilingual}.md")


def docx_text(content: bytes, separator: str = "\n") -> str:
    """The paragraphs of a DOCX file that aren't blank; tables and headers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        root = ElementTree.fromstring(package.read("word/document.xml"))
    body = root.find(f"{_WORD}body")
    found = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in (body if body is not None else []) if p.tag == f"{_WORD}p"]
    return separator.join(p for p in found if p.strip())


def docx_column(content: Column, separator: str = "\n") -> Column:
    """The body and error of DOCX files as a struct; one that can't be read has an error and no body."""

    @F.pandas_udf("struct<body: string, error: string>")
    def extract(contents):
        import pandas as pd

        rows = []
        for content in contents:
            try:
                rows.append((docx_text(content, separator), None))
            except Exception as failure:
                rows.append((None, str(failure) or type(failure).__name__))
        return pd.DataFrame(rows, columns=["body", "error"])

    return extract(content)


def read_docx(spark: SparkSession, paths: str | list[str], separator: str = "\n") -> DataFrame:
    """source, body, error of DOCX files; a file that can't be read has an error and no body."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.col("path").alias("source"), docx_column(F.col("content"), separator).alias("_d")).select("source", "_d.body", "_d.error")


def read_cue_table(spark: SparkSession, folder: str) -> DataFrame:
    """source, cue_index, timestamps, content of cues written by ``write_cue_table`` with their index. A cell
    without anything is null, two quotes are an empty text."""
    fields = "cue_index bigint, timestamps string, content string, source bigint"
    return spark.read.schema(fields).options(header=True, quote='"', escape='"', multiLine=True, nullValue="\0").csv(folder).select("source", "cue_index", "timestamps", "content")


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content, sort_key of a folder's own media files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
    return raw.where(is_batch_media(F.col("path"))).select("path", "length", "content", natural_key(F.regexp_extract("path", r"([^/]*)$", 1)).alias("sort_key"))
