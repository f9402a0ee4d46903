"""The pipeline, audio and the command line."""

import io
import wave

import pytest

from cuemill.cli import main
from cuemill.operators.media import clip_wav, clips, speaker_audio
from cuemill.plans.pipeline import documents, merged_settings, reports, simple_documents
from cuemill.providers import EchoModel

VTT = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello there. How are you?\n\n00:00:02.000 --> 00:00:04.500\nFine.\n"


def wav(samples: int) -> bytes:
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(1000)
        out.writeframes(b"".join(i.to_bytes(2, "little") for i in range(samples)))
    return buffer.getvalue()


def samples(content: bytes) -> list[int]:
    with wave.open(io.BytesIO(content)) as source:
        raw = source.readframes(source.getnframes())
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def test_audio(spark):
    assert samples(clip_wav(wav(10), [(2, 4), (8, 99)])) == [2, 3, 8, 9]
    assert samples(clip_wav(wav(10), [])) == []
    rows = spark.createDataFrame([("a.wav", bytearray(wav(10)), 1, 3), ("b.wav", bytearray(b"x"), 0, 1)], "name string, content binary, start_ms bigint, end_ms bigint")
    got = {r.name: r for r in clips(rows).collect()}
    assert samples(bytes(got["a.wav"].content)) == [1, 2] and got["b.wav"].error
    media = spark.createDataFrame([("s", "talk", bytearray(wav(10)))], "source string, base string, content binary")
    turns = spark.createDataFrame([("s", "A", 1, 5, 6), ("s", "A", 0, 0, 2), ("s", "B", 2, 2, 5)], "source string, speaker string, turn_no bigint, start_ms bigint, end_ms bigint")
    assert {r.name: samples(bytes(r.content)) for r in speaker_audio(media, turns).collect()} == {"talk_A.wav": [0, 1, 5], "talk_B.wav": [2, 3, 4]}


def test_documents(spark):
    bodies = spark.createDataFrame([("/x/a.vtt", VTT), ("/x/b.md", "One. Two."), ("/x/c.vtt", None), ("/x/d.txt", "")], "source string, body string")
    plain = {r.name: r.body for r in documents(bodies, EchoModel(), "rewrite").collect()}
    assert plain == {"a_rewritten.md": "[rewrite:Chinese] Hello there.How are you?。Fine.", "b_rewritten.md": "[rewrite:Chinese] One.Two."}
    cited = {r.name: r.body for r in documents(bodies, EchoModel(), "academic", cite=True, chunk_length=2).collect()}
    assert cited["a_academic.md"] == "### **00:00:00 - 00:00:02**\n\n[academic:English] Hello there。How are you。\n\n### **00:00:02 - 00:00:04**\n\n[academic:English] Fine。"
    translated = {r.name: r.body for r in documents(bodies, EchoModel(), "translate", language="French").collect()}
    assert translated["b_bilingual.md"] == "# English\nOne.Two.\n\n# French\n[translate:French] One.Two.\n\n---\n"
    assert reports(bodies, documents(bodies, EchoModel(), "rewrite")).count() == 2
    table, text = simple_documents(bodies.where("source like '%a.vtt'"))
    assert table.first().body.startswith("Timestamps,Content\n") and text.first().body == "Hello there.How are you?。Fine."
    with pytest.raises(ValueError):
        documents(bodies, EchoModel(), "sing")


def test_settings():
    assert merged_settings({"chunk_length": None}, {"chunk_length": 5})["chunk_length"] == 5
    assert merged_settings({"chunk_length": 3}, {"chunk_length": 5})["chunk_length"] == 3
    assert merged_settings({})["chunk_length"] == 20


def test_command_line(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(VTT)
    assert main(["rw", str(tmp_path / "a.vtt"), "--output-dir", str(tmp_path / "out")]) == 1
    assert (tmp_path / "out" / "a_rewritten.md").read_text().startswith("[rewrite:Chinese] ")
    with pytest.raises(SystemExit):
        main([])


def test_batches(spark):
    """One file that fails doesn't end the others."""
    from cuemill.plans.pipeline import batch_document, formal_documents, media_documents
    from cuemill.providers import FailingModel, PlainDecoder, SplitTranscriber
    from cuemill.sources.files import docx_text

    media = spark.createDataFrame([("/m/10.mp3", bytearray(b"Ten.")), ("/m/9.mp3", bytearray(b"Nine.")), ("/m/2.mp3", None), ("/m/3.mp3", bytearray(b"bad x")), ("/m/4.wav", bytearray(b""))], "path string, content binary")
    finished = media_documents(media, SplitTranscriber(), FailingModel(EchoModel(), "x"), "rewrite", decoder=PlainDecoder()).cache()
    got = {r.source: (r.status, r.error) for r in finished.collect()}
    assert got["/m/10.mp3"] == ("ok", None) and got["/m/2.mp3"] == ("error", "no content") and got["/m/3.mp3"] == ("error", "RuntimeError: the model failed") and got["/m/4.wav"][0] == "error"
    assert batch_document(finished).first().body == "## 9_rewritten.md\n\n[rewrite:Chinese] mp3:Nine.\n\n---\n\n## 10_rewritten.md\n\n[rewrite:Chinese] mp3:Ten.\n\n---\n\n"
    bodies = spark.createDataFrame([("/x/a.md", "One. Two.")], "source string, body string")
    formal = formal_documents(bodies, EchoModel()).first()
    assert formal.docx_name == "a_academic.docx" and docx_text(bytes(formal.content)) == formal.body == "[academic:English] One.Two."


def test_command_options(spark, tmp_path, capsys):
    (tmp_path / "a.vtt").write_text(VTT)
    (tmp_path / "c.yaml").write_text("max_tokens: 7\nlang: French\n")
    options = ["tr", str(tmp_path / "a.vtt"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.yaml"), "--llm", "openai/x", "-tm", "0.5", "--provider", "cuemill.providers:SettingsModel"]
    assert main(options) == 1
    assert "# French\n[openai x 7 3600 0.5] Hello" in (tmp_path / "out" / "a_bilingual.md").read_text()
    with pytest.raises(SystemExit, match="--multi-language"):
        main(["rw", str(tmp_path / "a.vtt"), "-m"])
    (tmp_path / "m.mp3").write_bytes(b"Said here.")
    assert main(["rw", str(tmp_path / "m.mp3"), "-o", str(tmp_path / "out"), "--transcriber", "cuemill.providers:SplitTranscriber", "-s", "de"]) == 1
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert main(["ac", str(tmp_path / "bad.docx"), "-o", str(tmp_path / "out")]) == 0 and "failed:" in capsys.readouterr().out


def test_writes_clips(spark, tmp_path):
    """Clips are written under the names that jobs give them; those that fail are told, not written."""
    from pyspark.sql import functions as F

    from cuemill.plans.jobs import clip_name
    from cuemill.sinks.files import write_documents

    rows = spark.createDataFrame([("/m/a.wav", "00:00:01", "00:00:02", None, bytearray(wav(3000))), ("/m/b.wav", None, None, "x.wav", bytearray(b"x"))], "path string, s string, e string, wav string, content binary")
    named = rows.select(clip_name(F.col("path"), F.col("s"), F.col("e"), F.col("wav")).alias("name"), "content", F.lit(1000).alias("start_ms"), F.lit(2000).alias("end_ms"))
    cut = clips(named).cache()
    assert [r.name for r in cut.where("error is not null").collect()] == ["b.wav"]
    assert write_documents(cut.where("error is null"), str(tmp_path), body="content").count() == 1
    assert samples((tmp_path / "a_00:00:01-00:00:02.wav").read_bytes()) == list(range(1000, 2000))
