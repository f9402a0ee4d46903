"""Operators that ask a provider, as Arrow batches: text models, language detection, transcription,
diarization, and the word-by-word comparison of two texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import plain_language, strip
from cuemill.operators.media import clip_wav
from cuemill.providers import AudioDecoder, AudioSlicer, Diarizer, LanguageDetector, MediaFetcher, ModelSettings, Request, TextModel, Transcriber

#: Texts a model gets at once, and how often a provider is asked before its error counts.
BATCH = 32
ATTEMPTS = 2


def tried(call: Callable[[], Any], attempts: int) -> tuple[Any, str | None]:
    """What a call gives, and None; or None and the last of ``attempts`` errors."""
    error = "no attempt"
    for _ in range(attempts):
        try:
            return call(), None
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
    return None, error


def model_map(paras: DataFrame, model: TextModel, task: str, language: str, text: str = "paragraph", *, settings: ModelSettings = ModelSettings(), attempts: int = ATTEMPTS) -> DataFrame:
    """Adds answer, status and error to every row: what a text model makes of ``text``.

    Null and blank texts are not asked and come back as they are, with status ``skipped``. Where a batch
    of texts fails ``attempts`` times, its texts are asked one by one; one that fails still has no
    answer, status ``error`` and the error. Rows stay where they are; spread them before if they are few.
    Columns of the same names are replaced.
    """
    request = Request(task, language, settings)

    def ask(texts: list[str]) -> list[tuple[str | None, str, str | None]]:
        answers, error = tried(lambda: checked(texts), attempts)
        if error is None:
            return [(answer, "ok", None) for answer in answers]
        return [found for one in texts for found in ask([one])] if len(texts) > 1 else [(None, "error", error)]

    def checked(texts: list[str]) -> list[str]:
        answers = list(model.run(request, texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
        return answers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            found: list[tuple[str | None, str, str | None]] = [(t, "skipped", None) for t in texts]
            for begin in range(0, len(asked), BATCH):
                part = asked[begin : begin + BATCH]
                for i, answer in zip(part, ask([texts[i] for i in part]), strict=True):
                    found[i] = answer
            columns = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "answer", "status", "error"])

    kept = paras.drop("answer", "status", "error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(work, f"{fields}, answer string, status string, error string")


def detect_languages(samples: DataFrame, detector: LanguageDetector, text: str = "sample") -> DataFrame:
    """Adds ``language``: of each sample, with all forms of Chinese as zh; en for blank ones and
    wherever detection fails."""

    @F.pandas_udf("string")
    def ask(texts):
        import pandas as pd

        try:
            return pd.Series(detector.detect([t or "" for t in texts]))
        except Exception:
            return pd.Series(["en"] * len(texts))

    blank = F.col(text).isNull() | (strip(F.col(text)) == "")
    return samples.withColumn("language", F.when(blank, "en").otherwise(plain_language(F.coalesce(ask(F.col(text)), F.lit("en")))))


_SEGMENT = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string())])


def _per_file(media: DataFrame, rows_of: Callable[[str, bytes], list[dict]], failed: Callable[[str, str], dict], fields: str, schema: pa.Schema, attempts: int) -> DataFrame:
    """Rows that a call makes of each media file (path, content), or one that tells its error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = (None, "no content") if content is None else tried(lambda path=path, content=content: rows_of(path, content), attempts)
                rows = [{**row, "status": "ok", "error": None} for row in rows] if error is None else [{**failed(path, error), "status": "error", "error": error}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select("path", "content").mapInArrow(work, f"{fields}, status string, error string")


_ENDING = [("status", pa.string()), ("error", pa.string())]


def fetched(inputs: DataFrame, fetcher: MediaFetcher, url: str = "path", *, attempts: int = ATTEMPTS) -> DataFrame:
    """path, content, status, error: the audio of each address."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), *_ENDING])
    named = inputs.select(F.col(url).alias("path"), F.col(url).cast("binary").alias("content"))
    return _per_file(named, lambda path, _: [{"path": path, "content": fetcher.fetch(path)}], lambda path, _: {"path": path, "content": None}, "path string, content binary", schema, attempts)


def decoded(media: DataFrame, decoder: AudioDecoder, *, attempts: int = ATTEMPTS) -> DataFrame:
    """path, content, status, error: media files as WAV data; those called .wav stay as they are."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), *_ENDING])

    def rows(path: str, content: bytes) -> list[dict]:
        ending = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        return [{"path": path, "content": content if ending == "wav" else decoder.decode(content, ending)}]

    return _per_file(media, rows, lambda path, _: {"path": path, "content": None}, "path string, content binary", schema, attempts)


def transcribed(media: DataFrame, transcriber: Transcriber, hint: str | None = None, *, attempts: int = ATTEMPTS) -> DataFrame:
    """source, language, segments, status, error of media files (path, content): segments have start_ms,
    end_ms, text. A file that fails has neither language nor segments."""
    schema = pa.schema([("source", pa.string()), ("language", pa.string()), ("segments", pa.list_(_SEGMENT)), *_ENDING])

    def rows(path: str, content: bytes) -> list[dict]:
        language, segments = transcriber.transcribe(content, hint)
        return [{"source": path, "language": language, "segments": [{"start_ms": int(a * 1000), "end_ms": int(b * 1000), "text": t} for a, b, t in segments]}]

    fields = "source string, language string, segments array<struct<start_ms: bigint, end_ms: bigint, text: string>>"
    return _per_file(media, rows, lambda path, _: {"source": path, "language": None, "segments": None}, fields, schema, attempts)


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """source, language, seg_no (from 1), start_ms, end_ms, text of transcripts; failed ones have none."""
    rows = transcripts.select("source", "language", F.posexplode("segments").alias("pos", "s"))
    return rows.select("source", "language", (F.col("pos") + 1).cast("bigint").alias("seg_no"), "s.start_ms", "s.end_ms", "s.text")


def diarized(media: DataFrame, diarizer: Diarizer, *, attempts: int = ATTEMPTS) -> DataFrame:
    """source, speaker, turn_no, start_ms, end_ms, status, error of media files (path, content); a file
    that fails has one row without a turn."""
    schema = pa.schema([("source", pa.string()), ("speaker", pa.string()), ("turn_no", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), *_ENDING])

    def rows(path: str, content: bytes) -> list[dict]:
        return [{"source": path, "speaker": speaker, "turn_no": i, "start_ms": int(a * 1000), "end_ms": int(b * 1000)} for i, (speaker, a, b) in enumerate(diarizer.turns(content))]

    return _per_file(media, rows, lambda path, _: {"source": path}, "source string, speaker string, turn_no bigint, start_ms bigint, end_ms bigint", schema, attempts)


def transcribed_by_speaker(media: DataFrame, diarizer: Diarizer, transcriber: Transcriber, hints: dict[str, str] | None = None, *, slicer: AudioSlicer = clip_wav, attempts: int = ATTEMPTS) -> DataFrame:
    """source, speaker, speaker_order, language, seg_no, start_ms, end_ms, text, status, error of media
    files (path, content) with several speakers.

    Each file's turns are told apart, each speaker's turns joined, and that audio transcribed, with the
    speaker's hint if there is one. Speakers are in the order in which they are first heard; times are
    those of the speaker's joined audio. All of it runs where the file is: audio is never shuffled.
    """
    fields = "source string, speaker string, speaker_order bigint, language string, seg_no bigint, start_ms bigint, end_ms bigint, text string"
    schema = pa.schema([("source", pa.string()), ("speaker", pa.string()), ("speaker_order", pa.int64()), ("language", pa.string()), ("seg_no", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), *_ENDING])

    def rows(path: str, content: bytes) -> list[dict]:
        ranges: dict[str, list[tuple[int, int]]] = {}
        for speaker, a, b in diarizer.turns(content):
            ranges.setdefault(speaker, []).append((int(a * 1000), int(b * 1000)))
        out = []
        for order, (speaker, turns) in enumerate(ranges.items(), 1):
            language, segments = transcriber.transcribe(slicer(content, turns), (hints or {}).get(speaker))
            out += [{"source": path, "speaker": speaker, "speaker_order": order, "language": language, "seg_no": i, "start_ms": int(a * 1000), "end_ms": int(b * 1000), "text": t} for i, (a, b, t) in enumerate(segments, 1)]
        return out

    return _per_file(media, rows, lambda path, _: {"source": path}, fields, schema, attempts)


def word_diff(before: str | None, after: str | None) -> str:
    """Markdown of the words that went (~~struck~~) and came (**bold**) from one text to another."""
    old, new = re.findall(r"\s+|[^\s]+", before or ""), re.findall(r"\s+|[^\s]+", after or "")
    out: list[str] = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append("".join(old[a:b]))
            continue
        for mark, words in (("~~", "".join(old[a:b])), ("**", "".join(new[c:d]))):
            inner = words.strip()
            out.append(words.replace(inner, f"{mark}{inner}{mark}", 1) if inner else words * (mark == "**"))
    return "".join(out)


def compared(texts: DataFrame, before: str, after: str) -> DataFrame:
    """Adds ``diff``: the word-by-word comparison of two columns."""

    @F.pandas_udf("string")
    def diff(a, b):
        import pandas as pd

        return pd.Series([word_diff(x, y) for x, y in zip(a, b, strict=True)])

    return texts.withColumn("diff", diff(F.col(before), F.col(after)))
