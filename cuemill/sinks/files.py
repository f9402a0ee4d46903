"""Writing rendered documents: one file per row, written on the executors, and tables as folders."""

from __future__ import annotations

import io
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'

_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def docx_bytes(text: str) -> bytes:
    """A DOCX file with a paragraph for each block of a text that isn't blank. Characters that XML cannot
    hold are left out."""
    blocks = [b.strip() for b in _NOT_XML.sub("", text).split("\n\n") if b.strip()]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(b)}</w:t></w:r></w:p>' for b in blocks)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", _CONTENT_TYPES)
        package.writestr("_rels/.rels", _RELATIONS)
        package.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def unique_names(documents: DataFrame, source: str = "source", name: str = "name") -> DataFrame:
    """The same rows, where names that several sources have are told apart by a hash of the source before
    the suffix. Only the names that occur more than once are joined, not gathered by name."""
    shared = documents.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(name, F.lit(True).alias("_shared"))
    mark = F.concat(F.lit("-"), F.lpad(F.lower(F.hex(F.xxhash64(source))), 16, "0"))
    told = F.concat(F.regexp_replace(name, r"(\.[^./]*)?$", ""), mark, F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return documents.join(shared, name, "left").withColumn(name, F.when(F.col("_shared"), told).otherwise(F.col(name))).select(documents.columns)


def _address(folder: str) -> str:
    """A folder as Arrow wants it: an absolute path, or an address with two slashes behind its scheme."""
    scheme, colon, rest = folder.partition(":")
    if not colon or len(scheme) < 2 or "/" in scheme:
        return os.path.abspath(folder)
    return folder if rest.startswith("//") else f"{scheme}://{rest}"


def write_documents(documents: DataFrame, folder: str, name: str = "name", body: str = "body", *, docx: bool = False) -> DataFrame:
    """Writes a file per row into ``folder`` (a path or an address of a file system that Arrow knows, such
    as hdfs:// or s3://), which all executors share; gives path and bytes of each.

    Bodies are text or binary; names may have folders. Each file is written beside its place and moved
    there, so that a task tried again leaves no half file. Names must differ (see ``unique_names``).
    Lazy: an action on the result writes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(_address(folder))
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = docx_bytes(content or "") if docx else content or b"" if isinstance(content, bytes) else (content or "").encode()
                inner = posixpath.normpath("/" + file).lstrip("/")
                path = f"{base.rstrip('/')}/{inner}"
                parent = posixpath.dirname(path)
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, path)
                paths.append(f"{folder.rstrip('/')}/{inner}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return documents.select(F.col(name), F.col(body)).mapInArrow(work, "path string, bytes bigint")


def docx_content(text: Column) -> Column:
    """A text as the bytes of a DOCX file."""

    @F.pandas_udf("binary")
    def made(texts):
        import pandas as pd

        return pd.Series([docx_bytes(t or "") for t in texts])

    return made(text)


def write_cue_table(cues: DataFrame, folder: str, *, index: bool = True) -> None:
    """Cues of all files as CSV, one folder per source, in order within each."""
    columns = (["cue_index"] if index else []) + ["timestamps", "content"]
    ordered = cues.repartition("source").sortWithinPartitions("source", "cue_index")
    ordered.select("source", *columns).write.mode("overwrite").partitionBy("source").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
