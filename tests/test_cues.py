"""Cue parsing, segmentation and chunking: golden cases, a state machine, and odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions import times as Z
from cuemill.operators.cues import explode_lines, language_sample, lines_as_cues, parse_cues, parse_cues_simply, running_text, untimed_files
from cuemill.operators.sentences import paragraphs_array, segment, timed_chunks
from cuemill.operators.stats import script_counts

GOLDEN = {
    "vtt": ("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello there. How are you?\n\n00:00:02.000 --> 00:00:04.500 align:start\nFine.\n", [("00:00:00.000 --> 00:00:02.000", "Hello there. How are you?"), ("00:00:02.000 --> 00:00:04.500 align:start", "Fine.")]),
    "srt": ("1\n00:00:01,000 --> 00:00:02,000\nA\n\n2\n00:00:03,000 --> 00:00:04,000\nB\n", [("00:00:01,000 --> 00:00:02,000", "A 2"), ("00:00:03,000 --> 00:00:04,000", "B")]),
    "short": ("WEBVTT\n\n00:01.000 --> 00:02.000\nA\n\n00:03.000 --> 00:04.000\nB\n", [("00:01.000 --> 00:02.000", "A 00:03.000 --> 00:04.000 B")]),
    "dialogue": ("[Events]\nDialogue: 0,Hi\nDialogue: 0,Yo\n", [("Dialogue: 0,Hi", "Dialogue: 0,Yo")]),
    "frames": ("{0}{25}Hi\n{25}{50}Yo\n", [("{0}{25}Hi", "{25}{50}Yo")]),
    "mode": ("Dialogue: x\nkeep\n00:00:01.000 --> 00:00:02.000\n7\n00:00:03.000 --> 00:00:04.000\nZ\n", [("Dialogue: x", "keep 00:00:01.000 --> 00:00:02.000"), ("00:00:03.000 --> 00:00:04.000", "Z")]),
    "none": ("", []),
}


def bodies(spark, rows):
    return spark.createDataFrame(rows, "source string, body string")


def cues_of(frame):
    out = {}
    for row in sorted(frame.collect(), key=lambda r: (r.source, r.cue_index)):
        out.setdefault(row.source, []).append((row.timestamps, row.content))
    return out


def test_golden(spark):
    got = cues_of(parse_cues(explode_lines(bodies(spark, [(k, body) for k, (body, _) in GOLDEN.items()]))))
    assert got == {k: rows for k, (_, rows) in GOLDEN.items() if rows}
    simple = cues_of(parse_cues_simply(explode_lines(bodies(spark, [("srt", GOLDEN["srt"][0])]))))
    assert [c for _, c in simple["srt"]] == ["A", "B"]


def machine(lines):
    """The parser as a machine that goes from line to line."""
    cues, state = [], "seek"
    for line in map(str.strip, lines):
        arrow = "-->" in line
        strict = bool(re.match(X.CUE_TIMES, line))
        talk = not arrow and ("Dialogue:" in line or re.match(r"\{\d+\}\{\d+\}", line))
        if state == "seek":
            if arrow:
                cues.append([line, []])
                state = "arrow"
            elif talk:
                cues.append([line, []])
                state = "talk"
        elif state == "arrow" and strict:
            cues.append([line, []])
        elif state == "talk" and line.isdigit():
            state = "seek"
        elif line:
            cues[-1][1].append(line)
    return [(head, " ".join(content)) for head, content in cues]


def test_random_files(spark):
    random.seed(7)
    kinds = ["00:00:01.000 --> 00:00:02.000", "x --> y", "Dialogue: a", "{1}{2}b", "12", "word", "", "  padded  "]
    files = [(f"f{i}", [random.choice(kinds) for _ in range(random.randint(0, 14))]) for i in range(300)]
    got = cues_of(parse_cues(explode_lines(bodies(spark, [(k, "".join(line + "\n" for line in lines)) for k, lines in files]))))
    for key, lines in files:
        assert got.get(key, []) == machine(lines), lines


def test_odd_lines(spark):
    rows = explode_lines(bodies(spark, [("a", "﻿x\r\ny\rz\n"), ("b", None), ("c", ""), ("d", "\n")])).collect()
    assert sorted((r.source, r.line_no, r.line) for r in rows) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("d", 0, "")]
    assert [r.line for r in explode_lines(bodies(spark, [("a", "p\x0bq r\n")]), in_memory=True).orderBy("line_no").collect()] == ["p", "q", "r"]
    assert [r.content for r in lines_as_cues(explode_lines(bodies(spark, [("a", "p\n\nq")]))).orderBy("cue_index").collect()] == ["p\n", "\n", "q\n"]


def cue_frame(spark, rows):
    return spark.createDataFrame(rows, "source string, cue_index bigint, timestamps string, content string")


def test_chunks(spark):
    rows = [("vtt", i, t, c) for i, (t, c) in enumerate(GOLDEN["vtt"][1])] + [("srt", i, t, c) for i, (t, c) in enumerate(GOLDEN["srt"][1])] + [("dots", 0, "00:00:01.000 --> 00:00:02.000", "..."), ("dots", 1, "00:00:03.000 --> 00:00:04.000", " "), ("none", 0, None, "x")]
    got = sorted((r.source, r.chunk_index, r.start, r.end, r.content) for r in timed_chunks(cue_frame(spark, rows), 2).collect())
    assert got == [("dots", 0, "00:00:01", "00:00:02", "..."), ("srt", 0, "00:00:01", "00:00:04", "A 2。B。"), ("vtt", 0, "00:00:00", "00:00:02", "Hello there。How are you。"), ("vtt", 1, "00:00:02", "00:00:04", "Fine。")]
    assert running_text(cue_frame(spark, rows)).where("source = 'vtt'").first().text == "Hello there. How are you?。Fine."
    assert {r.source: r.untimed for r in untimed_files(cue_frame(spark, rows)).collect()} == {"vtt": False, "srt": False, "dots": False, "none": True}
    assert language_sample(cue_frame(spark, rows), 1).where("source = 'vtt'").first().sample == "Hello there. How are you?"
    assert timed_chunks(cue_frame(spark, []), 2).count() == 0


@pytest.mark.parametrize(
    ("text", "n", "wanted"),
    [("Hello there. How are you?。Fine.", 2, ["Hello there.How are you?。", "Fine."]), ("A 2。B", 2, ["A 2。B，"]), ("第一。第二！”第三", 2, ["第一。第二！”，", "第三，"]), ("Hello. World\n", 20, ["Hello.World，"]), ("", 20, []), ("a. b. c.", 0, ["a.", "b.", "c."])],
)
def test_paragraphs(spark, text, n, wanted):
    frame = spark.createDataFrame([("s", text)], "source string, text string")
    assert frame.select(paragraphs_array(F.col("text"), n).alias("p")).first().p == wanted
    assert [r.paragraph for r in segment(frame, n).orderBy("para_index").collect()] == wanted


def test_long_and_null_texts(spark):
    long = "Word goes here. " * 20_000
    frame = spark.createDataFrame([("long", long), ("null", None)], "source string, text string")
    rows = segment(frame, 20).collect()
    assert len(rows) == 1000 and {r.source for r in rows} == {"long"}


def values(spark, column, **inputs):
    names = list(inputs)
    return spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


def test_strings_and_times(spark):
    assert values(spark, X.collapse_repeats(F.col("t")), t="你好你好 你好吗吗，ok ok") == "你好吗，ok ok"
    counts = script_counts(spark.createDataFrame([(1, "你好 world, привет—déjà"), (2, None)], "id int, t string"), "id", "t").orderBy("id").collect()
    assert (counts[0].cjk_chars, counts[0].other_words, counts[1].total) == (2, 3, None)
    for text, seconds in (("01:30", 5400), ("00:01:30", 90), ("1:2:3:4", 3723), ("x", None)):
        assert values(spark, Z.lenient_seconds(F.col("t")), t=text) == seconds
    assert values(spark, Z.strict_seconds(F.col("t")), t="01:30") is None
    assert values(spark, Z.clock(F.col("t").cast("bigint")), t="3723500") == "01:02:03.500"
    assert values(spark, Z.clock(F.col("t").cast("bigint")), t="360000000") == "100:00:00.000"
    assert values(spark, X.natural_key(F.col("a")) > X.natural_key(F.col("b")), a="10Constas", b="9Constas")
    assert values(spark, X.base_name(F.col("t")), t="/a/b.tar.gz") == "b.tar"
    assert values(spark, X.suffix(F.col("t")), t="/a/.hidden") == ""
    assert values(spark, X.input_kind(F.col("t")), t="www.example.org/x.mp4") == "url"
    assert values(spark, X.model_name(F.col("t")), t="openai/a/b") == "a/b"


@pytest.mark.parametrize("mark", list("。！？；：“”（）【】《》、") + ["一", "龥"])
def test_collapsed_characters(spark, mark):
    assert values(spark, X.collapse_repeats(F.col("t")), t=f"a{mark}{mark}　{mark}b") == f"a{mark}b"
    assert values(spark, X.collapse_repeats(F.col("t")), t=f"a，，{mark}x{mark}") == f"a，，{mark}x{mark}"


def test_ends_and_blank_sentences(spark):
    assert values(spark, X.complete(F.col("t")), t="Hi.\n") == "Hi.\n，" and values(spark, X.complete(F.col("t")), t="Hi.") == "Hi."
    assert values(spark, X.with_full_stop(F.col("t")), t="Hi.\n") == "Hi.\n。"
    blank = spark.createDataFrame([("a", "   "), ("b", "你好。 　")], "source string, text string")
    assert sorted((r.source, r.paragraph) for r in segment(blank, 10).collect()) == [("a", "，"), ("b", "你好。")]
    assert sorted((r.source, r.paragraph) for r in segment(blank, 10, collapse=True).collect()) == [("b", "你好。")]


def test_names_with_long_numbers(spark):
    names = ["a9", "a10", "a0010b", f"a{10**23 + 1}", f"a{10**23 + 2}", f"a{10**24}", "a", "b", "a-"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")))
    assert [r.n for r in frame.collect()] == ["a", "a9", "a10", "a0010b", f"a{10**23 + 1}", f"a{10**23 + 2}", f"a{10**24}", "a-", "b"]


def test_suffixes(spark):
    assert [values(spark, X.is_batch_media(F.col("t")), t=f"x.{e}") for e in ("WMV", "ogg", "webm", "aac", "wav")] == [True, True, False, False, True]
    assert [values(spark, X.input_kind(F.col("t")), t=t) for t in ("/a/.mp4", "/a/x.opus", "a.wav", "/a/x.markdown", "mp4")] == ["media", "media", "unsupported", "text", "unsupported"]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_chunks_whatever_the_block(spark, block):
    random.seed(5)
    rows = [(f, i, "00:00:01.000 --> 00:00:02.000", " ".join(random.choice(["One.", "Two words!", "", "三。四。"]) for _ in range(random.randint(0, 4)))) for f in "ab" for i in range(40)]
    got = timed_chunks(cue_frame(spark, rows), 3, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, timed_chunks(cue_frame(spark, rows), 3, block=10**6).collect()))
