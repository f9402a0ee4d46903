"""Audio as bytes in rows: cutting PCM WAV data to ranges, and joining the turns of each speaker."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_wav(content: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The given ranges of WAV data (in milliseconds, ends excluded) one after the other, as WAV data.
    Ranges beyond the end are cut; no range gives no sound."""
    with wave.open(io.BytesIO(content)) as source:
        rate, total, width = source.getframerate(), source.getnframes(), source.getsampwidth() * source.getnchannels()
        frames = source.readframes(total)
        settings = source.getparams()
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as target:
        target.setparams(settings._replace(nframes=0))
        for begin, end in ranges:
            a, b = (min(total, max(0, ms * rate // 1000)) for ms in (begin, end))
            target.writeframes(frames[a * width : b * width])
    return buffer.getvalue()


def _mapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            out = []
            for name, content, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append({"name": name, "content": clip_wav(content, [(r["start_ms"], r["end_ms"]) for r in ranges]), "error": None})
                except (wave.Error, EOFError, TypeError) as failure:
                    out.append({"name": name, "content": None, "error": str(failure) or type(failure).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.select(*columns).mapInArrow(work, "name string, content binary, error string")


def clips(media: DataFrame) -> DataFrame:
    """name, content, error of the clip of each row. Input: name, content, start_ms, end_ms."""
    ranges = F.array(F.struct(F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms")))
    return _mapped(media.withColumn("_r", ranges), ["name", "content", "_r"])


def speaker_audio(media: DataFrame, turns: DataFrame) -> DataFrame:
    """name ({base}_{speaker}.wav), content, error: each speaker's turns of each file, joined.
    Input: media with source, base and content; turns with source, speaker, turn_no, start_ms, end_ms."""
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "start_ms", "end_ms"))), lambda t: F.struct(t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms")))
    by_speaker = turns.groupBy("source", "speaker").agg(ranges.alias("_r"))
    joined = media.join(by_speaker, "source").withColumn("name", F.concat("base", F.lit("_"), "speaker", F.lit(".wav")))
    return _mapped(joined, ["name", "content", "_r"])
