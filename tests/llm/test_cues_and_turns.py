"""Repeated cues, speaker turns and splitting: brute force, odd input, hot files."""

import random

import pytest
import regex

from cuemill.llm.captions import has_words, is_blank, parse, same_words_key
from cuemill.llm.lexicon import language_of_label
from cuemill.llm.repeated_cues import cue_key, repeated_runs, similarity
from cuemill.llm.speaker_turns import captions_of, speaker_turns
from cuemill.llm.splitting import longest_unbroken_over, split_texts

CUES = "file_id bigint, cue_index bigint, timestamps string, content string, skey string, blk int"


def cues(spark, rows):
    return spark.createDataFrame([(f, i, t, c, "clash", 1) for f, i, t, c in rows], CUES)


def runs(frame):
    return sorted((r.file_id, r.first_cue, r.last_cue) for r in frame.collect())


def test_captions():
    assert parse("<v Ann Lee>Hi [music]").label == "Ann Lee" and parse("<v Ann Lee>Hi [music]").sounds == ("music",)
    assert parse("speaker 02 - Hi").label == "#02" and parse("- Ann: Hi").label == "Ann" and parse("维尔姆：你好").bare
    assert parse("(laughter) Ann: Hi").text == "Hi" and parse("Please write this: x").label is None
    assert parse(None).text == "" and is_blank("​ ") and not is_blank("-")
    assert not has_words("uh, um... hmm") and not has_words("嗯，唔…") and has_words("uh no")
    assert same_words_key("The the Kiln, uh, at 5.13!") == same_words_key("the kiln at 5，13") != same_words_key("the kiln at 51.3")


def test_similarity():
    key = lambda t: cue_key(t)
    same = [("Is the kiln really gone?!", "is the kiln relaly gone"), ("请看图13，那里展示了陶窑。", "请请看图13，那里展示了陶窑"), ("[Applause]", "(APPLAUSE)"), ("维尔姆：你好吗朋友们", "你好吗朋友们")]
    other = [("There are 38 people working.", "There are 39 people working."), ("请看图13，那里展示了陶窑。", "请看图13，那里展示了陶罐。"), ("奎森写道：“完成了。”", "德拉写道：“完成了。”"), ("[music]", "[applause]"), ("uh", "uh")]
    assert all(similarity(key(a), key(b)) > 0 for a, b in same)
    assert not any(similarity(key(a), key(b)) > 0 for a, b in other)


def test_runs(spark):
    t = "00:00:{:02d}.000 --> 00:00:{:02d}.500"
    rows = [(1, 0, t.format(0, 0), "Hello there my friend"), (1, 1, t.format(1, 1), None), (1, 2, t.format(2, 2), "HELLO there, my friend"), (1, 2, t.format(2, 2), "HELLO there, my friend"), (1, 3, "bad", "Something else here"), (1, 4, t.format(4, 4), "[music]"), (1, 5, t.format(5, 5), "♪"), (2, 0, None, "x"), (None, 0, None, "x"), (2, None, None, "x")]
    assert runs(repeated_runs(cues(spark, rows), smallest=2)) == [(1, 0, 2)]
    first = repeated_runs(cues(spark, rows), smallest=2).first()
    assert (first.n_cues, first.duration_ms) == (2, 2500)
    assert runs(repeated_runs(cues(spark, rows))) == [(1, 0, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5), (2, 0, 0)]
    assert repeated_runs(cues(spark, [])).count() == 0
    assert runs(repeated_runs(cues(spark, rows), smallest=2, max_gap_ms=100)) == []
    long = "word " * 50_000
    assert runs(repeated_runs(cues(spark, [(1, 0, None, long), (1, 1, None, long)]), smallest=2)) == [(1, 0, 1)]


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_runs_across_blocks(spark, block):
    random.seed(block)
    words = ["alpha beta gamma delta", "one two three four", None, "red green blue black"]
    rows = [(f, i, None, random.choice(words)) for f in range(3) for i in range(60)]
    wanted = []
    for f in range(3):
        said = [(i, c) for g, i, _, c in rows if g == f and c]
        k = 0
        while k < len(said):
            j = k
            while j + 1 < len(said) and said[j + 1][1] == said[k][1]:
                j += 1
            wanted.append((f, said[k][0], said[j][0]))
            k = j + 1
    assert runs(repeated_runs(cues(spark, rows), block=block)) == sorted(wanted)


def _arrow(rows, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches):
    return [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


@pytest.mark.parametrize("gap", [None, 1000])
def test_runs_whatever_the_block(gap):
    """Chains of slips give the same runs wherever blocks end as a file agglomerated as a whole."""
    import pyarrow as pa

    from cuemill.llm import repeated_cues as R

    random.seed(11)
    base = ["The old mill by the river is gone", "We saw the kiln on Monday", "yes", "no way", "[music]", "uh"]
    schema = pa.schema([("f", pa.int64()), ("b", pa.int64()), ("i", pa.int64()), ("c", pa.string()), ("s", pa.int64()), ("e", pa.int64())])
    for _ in range(300):
        said, at, rows = random.choice(base), 0, []
        for i in range(random.randint(1, 30)):
            if random.random() < 0.25:
                said = random.choice(base)
            content = said
            while random.random() < 0.45 and len(content) > 1:
                k = random.randrange(len(content))
                content = content[:k] + content[k + 1 :]
            if random.random() < 0.15:
                content = random.choice(["Ann: ", "维尔姆："]) + content
            at += random.choice([0, 500, 3000])
            rows.append((7, i, content if random.random() > 0.08 else None, at, at + random.choice([100, 900])))
        singles = [R.Run(i, i, 1, s, e, c, [cue_key(c)]) for _, i, c, s, e in rows if cue_key(c) is not None]
        wanted = [(7, r.first, r.last, r.count, r.start, r.end, r.content) for r in R.agglomerate(singles, R.TWO_SLIPS, gap)]
        for block in (1, 2, 3, 5):
            first = _rows(R._in_block(R.TWO_SLIPS, gap, 1)(iter([_arrow([(f, i // block, i, c, s, e) for f, i, c, s, e in rows], schema)])))
            first.sort(key=lambda r: r[:4])
            got = _rows(R._across_blocks(R.TWO_SLIPS, gap, 1)(iter([_arrow(first, R._ARROW)]))) if first else []
            assert sorted(got) == wanted


def walk(captions, known):
    """Turns of one file by walking over (number, speaker or None, says)."""
    speaker, turns = None, []
    for no, label, says in captions:
        if not says:
            continue
        speaker = label or speaker or (known[0] if len(known) == 1 else None)
        if speaker is None:
            continue
        if turns and turns[-1][2] == speaker:
            turns[-1][1] = no
        else:
            turns.append([no, no, speaker])
    return [tuple(t) for t in turns]


SPEAKERS = "file_id bigint, speaker string, display_name string"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_turns(spark, block):
    random.seed(block)
    labels = {"SPEAKER_00: ": "SPEAKER_00", "(Brannoch) ": "SPEAKER_01", "Branonch: ": "SPEAKER_01", "- Ann Lee: ": "SPEAKER_00", "": None, "A. Lee: ": "SPEAKER_00", "Please note: ": None, "speaker 01 - [ music ] ": "SPEAKER_01"}
    rows, wanted = [], []
    for f in (1, 2):
        known = ["SPEAKER_00"] if f == 2 else ["SPEAKER_00", "SPEAKER_01"]
        said = []
        for i in range(50):
            label = random.choice(["", "SPEAKER_00: "] if f == 2 else list(labels))
            text, says = random.choice([("we go on now", True), ("uh, um", False), ("[music]", False), (None, False)])
            rows.append((f, i, None, None if text is None else label + text))
            said.append((i, labels[label] if text else None, says or bool(text and "note" in label)))
        wanted += [("file", f, *t) for t in walk(said, known)]
    speakers = spark.createDataFrame([(1, "SPEAKER_00", "Ann Lee"), (1, "SPEAKER_01", "Tavik Brannoch"), (1, "SPEAKER_01", "Tavik Brannoch"), (2, "SPEAKER_00", None), (None, "x", "y")], SPEAKERS)
    empty = spark.createDataFrame([], "transcript_id bigint, file_id bigint, segments array<struct<start_s: double, end_s: double, text: string>>")
    frame = cues(spark, rows + rows[:5] + [(None, 1, None, "x")])
    got = speaker_turns(captions_of(frame, empty), speakers, block=block)
    assert sorted((r.item_type, r.item_id, r.first_no, r.last_no, r.speaker) for r in got.collect()) == sorted(wanted)


def test_captions_meet_speakers_by_block(spark):
    """Captions are joined to speakers by item and block, and shuffled by that alone before the windows."""
    empty = spark.createDataFrame([], "transcript_id bigint, file_id bigint, segments array<struct<start_s: double, end_s: double, text: string>>")
    speakers = spark.createDataFrame([(1, "SPEAKER_00", "Ann Lee")], SPEAKERS)
    plan = speaker_turns(captions_of(cues(spark, [(1, 0, None, "x")]), empty), speakers)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.split("\n") if "ShuffledHashJoin" in line and "LeftOuter" in line)
    assert "blk" in join and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_turns_leave_no_caption_out(spark, block):
    """Captions with the same place, places below 0 and far apart, long labels, digits of other scripts, and
    items of several files."""
    said = [
        (10, 1, -5, "Ann: before the start"), (11, 1, -4, "and on"), (12, 1, 7, "Bob: hello"), (13, 1, 7, "Ann: hello too"), (13, 1, 7, "Ann: hello too"), (14, 1, 7, "so it goes"), (15, 1, 8, "it goes on"),
        (16, 1, 9, "Doña Maria del Carmen de la Cruz: buenas"), (17, 1, 10, "[ " + "Wilhelmina " * 6 + "Velm ] hello"), (18, 1, 11, "المتحدث ٢: نعم"), (19, 1, 10**12, "ВЕЛМ сказал: нет"),
    ]
    given = spark.createDataFrame(said, "cue_id bigint, file_id bigint, cue_index bigint, content string")
    names = ["Ann", "Bob", "B. Other", "Doña Maria del Carmen de la Cruz", "Wilhelmina " * 6 + "Velm"]
    speakers = spark.createDataFrame([(1, f"SPEAKER_{i:02}", name) for i, name in enumerate(names)] + [(2, "SPEAKER_00", "Bob"), (3, "SPEAKER_07", "Ann")], SPEAKERS)
    segments = [{"start_s": 1.0, "end_s": 2.0, "text": "Ann: hi"}, {"start_s": 3.0, "end_s": 4.0, "text": "Bob: no"}]
    transcripts = spark.createDataFrame([(7, 1, segments), (7, 2, segments), (7, 3, segments), (7, None, segments)], "transcript_id bigint, file_id bigint, segments array<struct<start_s: double, end_s: double, text: string>>")
    got = speaker_turns(captions_of(given, transcripts), speakers, block=block).collect()
    assert sorted((r.first_no, r.last_no, r.speaker, r.n_captions) for r in got if r.item_type == "file") == [
        (-5, -4, "SPEAKER_00", 2), (7, 7, "SPEAKER_01", 1), (7, 8, "SPEAKER_00", 3), (9, 9, "SPEAKER_03", 1), (10, 10, "SPEAKER_04", 1), (11, 10**12, "SPEAKER_02", 2),
    ]
    assert sorted((r.first_no, r.last_no, r.speaker) for r in got if r.item_type == "transcript") == [(1, 1, "SPEAKER_00"), (1, 2, "SPEAKER_00"), (1, 2, "SPEAKER_07"), (2, 2, "SPEAKER_01")]


def test_turns_of_transcripts(spark):
    segments = [{"start_s": 9.0, "end_s": 9.5, "text": "and back"}, {"start_s": 1.0, "end_s": 2.0, "text": "Ann: hi"}, {"start_s": 3.0, "end_s": 4.0, "text": None}, {"start_s": 5.0, "end_s": 6.0, "text": "维尔姆：你好"}]
    rows = [(7, 1, segments), (7, 1, segments), (None, 1, segments), (8, 1, None)]
    transcripts = spark.createDataFrame(rows, "transcript_id bigint, file_id bigint, segments array<struct<start_s: double, end_s: double, text: string>>")
    speakers = spark.createDataFrame([(1, "SPEAKER_00", "Ann Lee"), (1, "SPEAKER_01", "维尔姆")], SPEAKERS)
    got = speaker_turns(captions_of(cues(spark, []), transcripts), speakers)
    assert sorted((r.item_id, r.first_no, r.last_no, r.speaker) for r in got.collect()) == [(7, 2, 2, "SPEAKER_00"), (7, 4, 1, "SPEAKER_01")]
    assert speaker_turns(captions_of(cues(spark, []), transcripts.limit(0)), speakers).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(30, 5), (400, 40), (20, 0)])
def test_split(spark, size, overlap):
    random.seed(size)
    letters = "ab c,.。！\n字字字é🎧́"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 900))) for _ in range(60)] + [None, "", "x" * 5000, "word " * 3000, "字" * size, "字" * (size + 1)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, content string").selectExpr("id", "content", "7 as piece", "8 as forced")
    pieces: dict = {}
    for row in split_texts(frame, "content", max_size=size, overlap=overlap).collect():
        pieces.setdefault(row.id, []).append(row)
    assert set(pieces) == {i for i, t in enumerate(texts) if t and len(t) > size}
    for i, rows in pieces.items():
        end = 0
        for row in sorted(rows, key=lambda r: r.piece_no):
            assert 0 < len(row.piece) <= size and texts[i][row.start_char - 1 :].startswith(row.piece)
            assert row.start_char - 1 == max(0, end - overlap) or row.piece_no == 1
            assert row.forced == (row.piece_no < len(rows) and not regex.search(r"(\s|\p{P})$", row.piece))
            end = row.start_char - 1 + len(row.piece)
        assert end == len(texts[i])
    marks = frame.select("id", longest_unbroken_over(frame.content, size).alias("u")).collect()
    assert {r.id: r.u for r in marks} == {i: None if t is None else bool(regex.search(rf"[^\s\p{{P}}]{{{size + 1}}}", t)) for i, t in enumerate(texts)}


def test_split_arguments(spark):
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([], "id int, content string"), "content", max_size=5, overlap=5)


def test_labels():
    assert [language_of_label(x) for x in ("EN", "zh_Hans", "English (UK)", "Deutsch", "jpn", "", None, "und", "??", "pt")] == ["en", "zh", "en", "de", "ja", None, None, None, None, "pt"]
