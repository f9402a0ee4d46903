"""Files, jobs, providers, rendering and the stream."""

import os

import pytest
from pyspark.sql import functions as F

from cuemill.operators import models as M
from cuemill.operators import timeline
from cuemill.plans import jobs as J
from cuemill.providers import AlternatingDiarizer, LinesTranscriber, ModelSettings, ScriptDetector, UpperCaseModel
from cuemill.sinks import render as R
from cuemill.sinks.files import docx_bytes, write_cue_table, write_documents
from cuemill.sources.files import docx_text, read_docx, read_media, read_subtitles, read_texts


def test_reads_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes(b"\xef\xbb\xbfA\xffB\n")
    (tmp_path / "b.docx").write_bytes(docx_bytes("one\n\n \n\ntwo & <three>"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "10.mp3").write_bytes(b"x")
    (tmp_path / "9.wav").write_bytes(b"y\nz")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("# d\n")
    assert read_subtitles(spark, f"{tmp_path}/a.vtt").first().body == "A�B\n"
    docs = {os.path.basename(r.source): (r.body, r.error) for r in read_docx(spark, f"{tmp_path}/*.docx").collect()}
    assert docs["b.docx"] == ("one\ntwo & <three>", None) and docs["c.docx"][0] is None and docs["c.docx"][1]
    assert docx_text(docx_bytes("a\n\nb"), "\n\n") == "a\n\nb"
    assert [os.path.basename(r.path) for r in read_media(spark, str(tmp_path)).orderBy("sort_key").collect()] == ["9.wav", "10.mp3"]
    assert read_texts(spark, str(tmp_path), recursive=True, glob="*.md").count() == 1
    media = read_media(spark, str(tmp_path)).where("path like '%wav'")
    assert [s.text for s in M.transcribed(media, LinesTranscriber()).first().segments] == ["y", "z"]
    assert M.diarized(media, AlternatingDiarizer()).count() == 2


def test_writes_files(spark, tmp_path):
    rows = spark.createDataFrame([("x.md", "text"), ("y.md", None)], "name string, body string")
    assert {os.path.basename(r.path): r.bytes for r in write_documents(rows, str(tmp_path / "out")).collect()} == {"x.md": 4, "y.md": 0}
    assert (tmp_path / "out" / "x.md").read_text() == "text"
    cues = spark.createDataFrame([("s", 0, "t", 'a "b", c')], "source string, cue_index bigint, timestamps string, content string")
    write_cue_table(cues, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().content == 'a "b", c'


def test_jobs(spark):
    texts = ["output_dir: out\ninput: /m/talk.mp4\nsegments:\n  - start_time: '00:00:10'\n    end_time: '00:01:00'\n  - start_time: '00:01:00'\n    end_time: '00:02:00'\n    title: Second\n  - just text\n", "inputs:\n  - input: /m/a.wav\n    title: A\n  - input: https://x.example/b\ntranscribe_model: base\n", ""]
    rows = J.expand_jobs(J.load_jobs(spark, texts)).orderBy("job_id", "input_no", "segment_no").collect()
    assert [(r.job_id, r.segment_no, r.title, r.transcribe_model) for r in rows] == [(0, 0, "Segment 1", "large-v3"), (0, 1, "Second", "large-v3"), (1, None, "A", "base"), (1, None, "b", "base")]
    routes = J.routed(spark.createDataFrame([("a.vtt",), ("a.docx",), ("a.exe",), (None,)], "path string")).collect()
    assert [(r.route, r.error) for r in routes] == [(None, "no route for this type"), ("academic", None), (None, "unsupported input"), (None, "no input")]
    kept = J.kept_results(spark.createDataFrame([("t", "b"), ("", "b"), ("t", None)], "text string, base_name string"))
    assert kept.count() == 1


def test_models(spark):
    paras = spark.createDataFrame([("s", 0, "one"), ("s", 1, " "), ("s", 2, None)], "source string, para_index bigint, paragraph string")
    assert [r.answer for r in M.model_map(paras, UpperCaseModel(), "rewrite", "English").orderBy("para_index").collect()] == ["ONE", " ", None]
    samples = spark.createDataFrame([("a", "你好"), ("b", ""), ("c", None), ("d", "hello")], "source string, sample string")
    assert {r.source: r.language for r in M.detect_languages(samples, ScriptDetector()).collect()} == {"a": "zh", "b": "en", "c": "en", "d": "en"}
    assert M.word_diff("a b c", "a x c") == "a ~~b~~**x** c"
    assert M.word_diff(None, "new") == "**new**"
    assert (ModelSettings("openai/gpt").provider, ModelSettings("qwen3").provider, ModelSettings("gemini/x").needs_key) == ("openai", "ollama", "GOOGLE_API_KEY")
    pair = M.compared(spark.createDataFrame([("s", "a b", "a c")], "source string, x string, y string"), "x", "y")
    assert R.compare_report(pair.select("source", "diff")).first().body.endswith("a ~~b~~**c**")


def test_time_line(spark):
    turns = spark.createDataFrame([("s", "B", 0, 0, 10), ("s", "A", 1, 10, 15), ("s", "B", 2, 15, 30)], "source string, speaker string, turn_no bigint, start_ms bigint, end_ms bigint")
    assert {(r.speaker, r.speaker_order) for r in timeline.turns_by_speaker(turns).collect()} == {("B", 1), ("A", 2)}
    assert [(r.local_start_ms, r.local_end_ms) for r in timeline.rebased(turns).orderBy("turn_no").collect()] == [(0, 10), (0, 5), (10, 25)]
    assert timeline.clipped(turns, 12, 20).agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0] == 8
    segments = spark.createDataFrame([("s", 1, 0, 1500, "t1"), ("s", 2, 1500, 3000, "t2")], "source string, seg_no bigint, start_ms bigint, end_ms bigint, text string")
    assert R.transcript_vtt(segments).first().body == "WEBVTT\n \n00:00:00.000 --> 00:00:01.500\nt1 \n00:00:01.500 --> 00:00:03.000\nt2"


def test_stream(spark, tmp_path):
    from cuemill.streaming.cues import stream_cues

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello\n")
    got = []
    query = stream_cues(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda cues, n: got.extend(cues.collect()))
    query.awaitTermination(60)
    assert [(r.cue_index, r.content) for r in got] == [(0, "Hello")]


def test_checkpoint_folder(spark, tmp_path):
    from cuemill.session import checkpoint

    frame = checkpoint(spark.range(3))
    assert frame.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "nothing"))


def test_failures_are_rows(spark):
    from cuemill.providers import BytesFetcher, EchoModel, FailingModel, LinesDiarizer, PlainDecoder, Request, SettingsModel, SplitTranscriber, slice_lines

    paras = spark.createDataFrame([("s", i, t) for i, t in enumerate(["one", "bad x", None, " ", "two"])], "source string, para_index bigint, paragraph string").coalesce(1)
    got = M.model_map(paras, FailingModel(EchoModel(), "x"), "rewrite", "English").orderBy("para_index").collect()
    assert [(r.answer, r.status) for r in got] == [("[rewrite:English] one", "ok"), (None, "error"), (None, "skipped"), (" ", "skipped"), ("[rewrite:English] two", "ok")]
    assert got[1].error == "RuntimeError: the model failed"

    class Short:
        def run(self, request, texts):
            return []

    assert {r.status for r in M.model_map(paras.where("para_index = 0"), Short(), "rewrite", "English").collect()} == {"error"}
    assert SettingsModel().run(Request("rewrite", "German", ModelSettings("gemini/x", 7)), ["t"]) == ["[gemini x 7 3600 0.1] t"]
    media = spark.createDataFrame([("a.mp3", bytearray(b"one\ntwo\nthree")), ("b.mp3", None), ("c.mp3", bytearray(b" "))], "path string, content binary")
    assert {r.source: r.status for r in M.transcribed(media, SplitTranscriber()).collect()} == {"a.mp3": "ok", "b.mp3": "error", "c.mp3": "ok"}
    assert {r.source: r.error for r in M.diarized(media, LinesDiarizer()).where("status = 'error'").collect()} == {"b.mp3": "no content", "c.mp3": "ValueError: no sound"}
    said = M.transcribed_by_speaker(media.where("path = 'a.mp3'"), LinesDiarizer(), SplitTranscriber(), {"SPEAKER_01": "fr"}, slicer=slice_lines).orderBy("speaker", "seg_no").collect()
    assert [(r.speaker, r.language, r.start_ms, r.text) for r in said] == [("SPEAKER_00", "en", 0, "one"), ("SPEAKER_00", "en", 2000, "two"), ("SPEAKER_01", "fr", 0, "three")]
    assert [bytes(r.content) for r in M.decoded(media, PlainDecoder()).where("status = 'ok'").orderBy("path").collect()] == [b"mp3:one\ntwo\nthree", b"mp3: "]
    urls = spark.createDataFrame([("http://a",), ("http://b.invalid",)], "path string")
    assert {r.path: r.status for r in M.fetched(urls, BytesFetcher()).collect()} == {"http://a": "ok", "http://b.invalid": "error"}
    assert M.model_map(paras.limit(0), EchoModel(), "rewrite", "English").count() == 0 and M.transcribed(media.limit(0), SplitTranscriber()).count() == 0


def test_settings_of_providers():
    from cuemill.providers import Request, preset

    assert ModelSettings("Gemini/x").provider == "gemini" and preset("ollama").max_tokens == 130_000 and preset("gemini").endpoint.startswith("https://generativelanguage")
    assert ModelSettings("openai/g").key({"OPENAI_API_KEY": "k"}) == "k" and ModelSettings("qwen3").key({}) is None
    assert ModelSettings("gemini/g").key({"GOOGLE_API_KEY_JSON": "j"}) == "j"
    for fails in (lambda: ModelSettings("openai/g").key({}), lambda: preset("none"), lambda: Request("sing", "x").instructions):
        with pytest.raises(ValueError):
            fails()
    assert "95 %" in Request("rewrite", "German").instructions and "German" in Request("translate", "German").instructions


def test_job_settings(spark):
    texts = ["output_dir: out\ntimeout: 600\nmulti_language: false\ninput: /m/one.mp4\ninputs:\n  - input: /m/a.wav\n    timeout: 5\n    transcribe_model:\n    segments:\n      - title: T\n        output_wav: x.wav\ntranscribe_model: base\n"]
    rows = J.expand_jobs(J.load_jobs(spark, texts)).orderBy("input_no").collect()
    assert [(r.input, r.title, r.transcribe_model, r.output_wav) for r in rows] == [("/m/one.mp4", "one", "base", None), ("/m/a.wav", "T", "large-v3", "x.wav")]
    assert rows[0].settings == {"output_dir": "out", "timeout": "600", "multi_language": "false", "transcribe_model": "base"} and rows[1].settings["timeout"] == "5"
    flags = spark.createDataFrame([("a.vtt", "tiny", True, "de"), ("a.mp4", "tiny", True, "de"), ("a.vtt", "large-v3", False, None), (None, None, None, "de")], "p string, m string, s boolean, l string")
    got = [r[0] for r in flags.select(J.misplaced_flags(F.col("p"), F.col("m"), F.col("s"), F.col("l"))).collect()]
    assert got == ["only for media and addresses: --transcribe-model, --multi-language, --transcribe-lang", None, None, "only for media and addresses: --transcribe-lang"]


def test_names_and_bad_files(spark, tmp_path):
    from cuemill.sinks.files import unique_names
    from cuemill.sources.files import read_finished

    rows = spark.createDataFrame([("/a/t.vtt", "t.md", "one"), ("/b/t.vtt", "t.md", "two"), ("/b/u.vtt", "u.md", "three"), ("/c/v", "v", None)], "source string, name string, body string")
    written = write_documents(unique_names(rows), str(tmp_path / "out")).collect()
    names = sorted(os.path.basename(r.path) for r in written)
    assert len(set(names)) == 4 and names[2:] == ["u.md", "v"] and all(n.startswith("t-") and n.endswith(".md") for n in names[:2])
    nested = spark.createDataFrame([("x/t.md", bytearray(b"1")), ("../../y/t.md", bytearray(b"22"))], "name string, body binary")
    assert sorted((r.path, r.bytes) for r in write_documents(nested, f"file://{tmp_path}/n").collect()) == [(f"file://{tmp_path}/n/x/t.md", 1), (f"file://{tmp_path}/n/y/t.md", 2)]
    (tmp_path / "a_rewritten.md").write_text("a\nb")
    (tmp_path / "b_bilingual.md").write_text("")
    (tmp_path / "c_rewritten.md").write_bytes(b"\xff")
    (tmp_path / "d_academic.md").write_text("d")
    (tmp_path / "e 1+1_rewritten.md").write_text("")
    assert sorted((os.path.basename(r.source), r.body, r.error) for r in read_finished(spark, str(tmp_path)).collect()) == [("a_rewritten.md", "a\nb", None), ("b_bilingual.md", "", None), ("c_rewritten.md", None, "not UTF-8"), ("e 1+1_rewritten.md", "", None)]


def test_reports(spark):
    report = R.compare_report(spark.createDataFrame([("s", "x")], "source string, diff string")).first().body
    assert report.startswith("# Academic Writing Comparison\n\nThis document shows") and report.endswith("## Comparison:\n\nx")
    rows = spark.createDataFrame([("s", "a.docx", "b.docx", "x")], "source string, original string, modified string, diff string").withColumn("date", F.lit("2025-05-06 07:08:09").cast("timestamp"))
    assert R.documents_report(rows).first().body == "# Document Comparison\n\n**Original:** a.docx\n**Modified:** b.docx\n**Date:** 2025-05-06 07:08:09\n\n## Changes\n\nx"
    files = spark.createDataFrame([("k", 1, "a.mp4", "said"), ("k", 2, "b.mp4", None)], "key string, n int, name string, content string")
    assert R.plain_batch_document(files, "key", "n").first().body == "## a.mp4\n\nsaid\n\n## b.mp4\n\n"
