"""The queries of the core, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions import times as Z
from cuemill.operators import cues as C
from cuemill.operators import models as M
from cuemill.operators import sentences as S
from cuemill.operators import stats, timeline
from cuemill.plans import jobs as J
from cuemill.plans import pipeline as P
from cuemill.plans import tables as T
from cuemill.providers import BytesFetcher, EchoModel, FailingModel, LinesDiarizer, ModelSettings, PlainDecoder, ScriptDetector, SettingsModel, SplitTranscriber, slice_lines
from cuemill.session import checkpoint, scratch, table
from cuemill.sinks import render as R
from cuemill.sinks.files import docx_content, write_cue_table, write_documents
from cuemill.sources.files import docx_column, read_cue_table, read_finished, read_subtitles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


# ---- SQL of the shared pieces: patterns and lists are written out, so that a wrong one of the library shows ----
W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIMES = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
_ENDS = "[.!?。！？]"
_MARKS = "[，。？！]"
_MEDIA = "mp4|avi|mov|mkv|flv|wmv|m4v|webm|mp3|flac|aac|ogg|m4a|opus"
_TEXTS = "vtt|srt|ass|ssa|sub|smi|txt|md|markdown|docx"
_BATCH = "('mp4', 'avi', 'mkv', 'mov', 'wmv', 'mp3', 'wav', 'm4a', 'ogg', 'flac')"


def strip(x: str) -> str:
    """White space off the ends."""
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def complete(x: str) -> str:
    """A comma after what has no punctuation at its end."""
    return f"CASE WHEN regexp_matches({x}, '[，。？！,.!?]\\z') THEN {x} ELSE {x} || '，' END"


def clock(x: str) -> str:
    """Milliseconds as a clock time."""
    return f"lpad(CAST({x} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({x} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(({x} // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({x} // 1000) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"


CUES = "c AS (SELECT file_id AS source, cue_index, min(timestamps) AS timestamps, min(content) AS content FROM cues WHERE file_id IS NOT NULL AND cue_index IS NOT NULL GROUP BY 1, 2)"
_VTT = "coalesce(timestamps, '') || chr(10) || coalesce(content, '') || chr(10)"
_FRAMES = "'{' || cue_index || '}{' || (cue_index + 1) || '}' || coalesce(content, '')"
PIECES = {
    "vtt": ("'WEBVTT' || chr(10) || chr(10) || ", _VTT),
    "srt": ("", f"(cue_index + 1) || chr(10) || {_VTT}"),
    "dialogue": ("'[Events]' || chr(10) || ", "'Dialogue: 0,' || coalesce(timestamps, '') || ',,' || coalesce(content, '')"),
    "frames": ("", _FRAMES),
    "mixed": (
        "",
        f"CASE cue_index % 7 WHEN 0 THEN 'Dialogue: ' || coalesce(content, '') WHEN 1 THEN CAST(cue_index AS VARCHAR) WHEN 2 THEN coalesce(content, '') WHEN 3 THEN {_FRAMES} ELSE CASE WHEN source % 3 = 0 AND cue_index < 40 THEN coalesce(content, '') ELSE {_VTT} END END",
    ),
}


def bodies(form: str) -> str:
    head, piece = PIECES[form]
    return f"{CUES}, b AS (SELECT source, {head}string_agg({piece}, chr(10) ORDER BY cue_index) AS body FROM c GROUP BY 1)"


LINES = """a AS (SELECT source, string_split_regex(regexp_replace(body, '^\\x{feff}', ''), '\\r\\n|\\r|\\n') AS l FROM b),
a2 AS (SELECT source, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM a),
ln AS (SELECT source, i - 1 AS line_no, l[i] AS line FROM a2, unnest(range(1, len(l) + 1)) AS t(i))"""

SEGMENTS = """tr AS (SELECT DISTINCT transcript_id AS source, coalesce(detected_language, 'und') AS language, segments FROM transcripts WHERE transcript_id IS NOT NULL),
sg AS (SELECT source, CASE i % 4 WHEN 0 THEN 'zh-CN' WHEN 2 THEN 'zh' ELSE language END AS language, i AS seg_no, 'S' || (i % 3) AS speaker, CAST(trunc(segments[i].start_s * 1000) AS BIGINT) AS start_ms, CAST(trunc(segments[i].end_s * 1000) AS BIGINT) AS end_ms, segments[i].text AS text FROM tr, unnest(range(1, len(segments) + 1)) AS t(i))"""

PAIRS = "p AS (SELECT file_id AS source, pair_id AS para_index, min(text) AS paragraph, min(rewritten) AS answer FROM para_rewrites WHERE pair_id IS NOT NULL AND file_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)"

TRANSLATIONS = "p AS (SELECT file_id AS source, pair_id AS para_index, min(english_text) AS paragraph, min(translate_language) AS target FROM translations WHERE pair_id IS NOT NULL AND file_id IS NOT NULL AND english_text IS NOT NULL GROUP BY 1, 2)"


def parse_sql(form: str, simply: bool = False) -> str:
    times = rf"^{_TIMES}\s*-->\s*{_TIMES}" if simply else f"^{_TIMES} --> {_TIMES}"
    classes = f"k AS (SELECT *, contains(x, '-->') AS loose, contains(x, '-->') AND regexp_matches(x, '{times}') AS strict, NOT contains(x, '-->') AND (contains(x, 'Dialogue:') OR regexp_matches(x, '^\\{{\\d+\\}}\\{{\\d+\\}}')) AS talk, regexp_matches(x, '^[\\p{{Nd}}\\p{{No}}]+$') AS num FROM (SELECT *, {strip('line')} AS x FROM ln))"
    so_far = "OVER (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    if simply:
        starts = f"""h AS (SELECT *, min(CASE WHEN loose THEN line_no END) OVER (PARTITION BY source, blk) AS head FROM (SELECT *, sum(CAST(num AS INT)) {so_far} AS blk FROM k)),
s AS (SELECT *, coalesce(strict OR (loose AND line_no = head), false) AS starts, NULL AS first FROM h)"""
        member = "starts OR blk = start_blk"
    else:
        starts = f"""h AS (SELECT *, min(CASE WHEN loose OR talk THEN line_no END) OVER (PARTITION BY source, blk) AS head FROM (SELECT *, sum(CAST(num AS INT)) {so_far} AS blk FROM k)),
f AS (SELECT *, min(CASE WHEN loose AND line_no = head THEN line_no END) OVER (PARTITION BY source) AS first FROM h),
s AS (SELECT *, coalesce((talk AND line_no = head AND (first IS NULL OR line_no < first)) OR line_no = first OR (line_no > first AND strict), false) AS starts FROM f)"""
        member = "starts OR coalesce(line_no > first, false) OR blk = start_blk"
    return f"""WITH {bodies(form)}, {LINES}, {classes}, {starts},
q AS (SELECT *, max(CASE WHEN starts THEN blk END) OVER (PARTITION BY source, cue) AS start_blk FROM (SELECT *, sum(CAST(starts AS INT)) {so_far} AS cue FROM s) WHERE cue > 0)
SELECT source, CAST(cue - 1 AS BIGINT) AS cue_index, max(CASE WHEN starts THEN x END) AS timestamps, coalesce(string_agg(CASE WHEN x <> '' AND NOT starts THEN x END, ' ' ORDER BY line_no), '') AS content
FROM q WHERE {member} GROUP BY source, cue"""


def _parsed(form: str, simply: bool = False) -> Query:
    parse = C.parse_cues_simply if simply else C.parse_cues
    return lambda spark, folder: parse(C.explode_lines(T.subtitle_bodies(spark, folder, form)))


for _form in ("vtt", "srt", "dialogue", "frames", "mixed"):
    query(f"parse_{_form}_cues", parse_sql(_form))(_parsed(_form))
for _form in ("vtt", "srt"):
    query(f"parse_mini_{_form}", parse_sql(_form, True))(_parsed(_form, True))


@query("txt_cues", f"WITH b AS (SELECT doc_id AS source, text AS body FROM documents WHERE text IS NOT NULL AND fmt = 'txt'), {LINES} SELECT source, CAST(line_no AS BIGINT) AS cue_index, '' AS timestamps, line || chr(10) AS content FROM ln")
def txt_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of plain text documents as cues."""
    texts = table(spark, folder, "documents").where("fmt = 'txt'").select(F.col("doc_id").alias("source"), F.col("text").alias("body"))
    return C.lines_as_cues(C.explode_lines(texts))


@query("join_cues_fullstop", f"WITH {CUES} SELECT source, string_agg(content, '。' ORDER BY cue_index) AS text FROM c WHERE content IS NOT NULL GROUP BY 1")
def join_cues_fullstop(spark: SparkSession, folder: str) -> DataFrame:
    """A file's cues as running text."""
    return C.running_text(T.unique_cues(spark, folder))


@query("cue_validation", f"WITH {CUES} SELECT source, bool_or(timestamps IS NULL OR timestamps = '') AS untimed FROM c GROUP BY 1")
def cue_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a cue without times."""
    return C.untimed_files(T.unique_cues(spark, folder))


_SAMPLE = "string_agg(content, ' ' ORDER BY cue_index)"


@query("language_sample_head20", f"WITH {CUES} SELECT source, {_SAMPLE} AS sample, {strip(_SAMPLE)} = '' AS blank FROM c WHERE cue_index < 20 AND content IS NOT NULL GROUP BY 1")
def language_sample_head20(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty cues of a file, from which its language is guessed."""
    return C.language_sample(T.unique_cues(spark, folder))


_RANGES = [("ja", "3040", "30ff"), ("zh", "4e00", "9fff"), ("ru", "0400", "04ff"), ("ar", "0600", "06ff"), ("hi", "0900", "097f"), ("th", "0e00", "0e7f")]


def detected_sql(x: str) -> str:
    """The language of a text by the script that most of its letters have."""
    counts = "[" + ", ".join(f"length(regexp_replace({x}, '[^\\x{{{a}}}-\\x{{{z}}}]', '', 'g'))" for _, a, z in _RANGES) + "]"
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
    return f"CASE WHEN list_max({counts}) = 0 OR list_max({counts}) * 2 < {letters} OR {strip(x)} = '' THEN 'en' ELSE {[code for code, _, _ in _RANGES]}[list_position({counts}, list_max({counts}))] END"


@query("detect_languages", f"WITH {CUES}, t AS (SELECT source, {_SAMPLE} AS sample FROM c WHERE cue_index < 20 AND content IS NOT NULL GROUP BY 1) SELECT source, {detected_sql('sample')} AS language FROM t")
def detect_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each file's sample by the stand-in detector."""
    return M.detect_languages(C.language_sample(T.unique_cues(spark, folder)), ScriptDetector()).select("source", "language")


def _sentences_sql(x: str) -> str:
    e = _ENDS
    marked = f"CASE WHEN regexp_matches({x}, '{_MARKS}') THEN regexp_replace({x}, '({e}\\p{{P}}*){W}*', '\\1' || chr(1), 'g') ELSE regexp_replace({x}, '({e}\\p{{P}}*){W}+', '\\1' || chr(1), 'g') END"
    return f"string_split({marked}, chr(1))"


def segment_sql(source: str, n: int) -> str:
    return f"""WITH t AS ({source}), q AS (SELECT source, {_sentences_sql('text')} AS l FROM t WHERE text IS NOT NULL AND text <> ''),
q2 AS (SELECT source, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM q),
s AS (SELECT source, i, {complete('z')} AS z FROM (SELECT source, i, {strip('l[i]')} AS z FROM q2, unnest(range(1, len(l) + 1)) AS u(i)))
SELECT source, CAST((i - 1) // {n} AS BIGINT) AS para_index, string_agg(z, '' ORDER BY i) AS paragraph FROM s GROUP BY 1, 2"""


_DOCS = "SELECT doc_id AS source, text FROM documents"
_RUNNING = f"WITH {CUES} SELECT source, string_agg(content, '。' ORDER BY cue_index) AS text FROM c WHERE content IS NOT NULL GROUP BY 1"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("source"), "text")


for _n in (20, 1):
    query(f"segment_documents_n{_n}", segment_sql(_DOCS, _n))(lambda spark, folder, n=_n: S.segment(_documents(spark, folder), n))
query("segment_cues_n20", segment_sql(_RUNNING, 20))(lambda spark, folder: S.segment(C.running_text(T.unique_cues(spark, folder)), 20))
query("segment_collapsed_n10")(lambda spark, folder: S.segment(_documents(spark, folder), 10, collapse=True))
query("collapse_repeats")(lambda spark, folder: table(spark, folder, "documents").select("doc_id", X.collapse_repeats(F.col("text")).alias("text")))


def chunks_sql(n: int) -> str:
    cut = lambda z: f"CASE WHEN contains({z}, '.') THEN string_split({z}, '.')[1] ELSE string_split({z}, ',')[1] END"
    part = lambda i: cut(strip(f"string_split(timestamps, '-->')[{i}]"))
    return f"""WITH {CUES}, t AS (SELECT * FROM c WHERE {strip('content')} <> '' AND {strip('timestamps')} <> ''),
s AS (SELECT *, list_filter(list_transform(string_split_regex(content, '{_ENDS}'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM t),
e AS (SELECT source, cue_index, timestamps, i, l[i] AS sentence FROM (SELECT source, cue_index, timestamps, CASE WHEN len(l) = 0 THEN [content] ELSE l END AS l FROM s), unnest(range(1, len(l) + 1)) AS u(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cue_index, i) AS rn, CASE WHEN contains(timestamps, '-->') THEN {part(1)} ELSE timestamps END AS a, CASE WHEN contains(timestamps, '-->') THEN {part(2)} ELSE timestamps END AS z FROM e),
g AS (SELECT source, CAST((rn - 1) // {n} AS BIGINT) AS chunk_index, arg_min(a, rn) AS "start", arg_max(z, rn) AS "end", string_agg(sentence, '。' ORDER BY rn) AS content FROM r GROUP BY 1, 2)
SELECT source, chunk_index, "start", "end", CASE WHEN regexp_matches(content, '{_ENDS}\\z') THEN content ELSE content || '。' END AS content FROM g"""


for _n in (2, 20):
    query(f"timestamped_chunks_n{_n}", chunks_sql(_n))(lambda spark, folder, n=_n: S.timed_chunks(T.unique_cues(spark, folder), n))

_SECTIONS = f"""SELECT source, string_agg('### **' || "start" || ' - ' || "end" || '**' || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM ({chunks_sql(20)}) GROUP BY 1"""


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return S.sections_text(S.timed_chunks(T.unique_cues(spark, folder), 20))


query("timestamped_sections", _SECTIONS)(_sections)


def paragraphs_sql(source: str) -> str:
    return f"SELECT source, CAST(i - 1 AS BIGINT) AS para_index, l[i] AS paragraph FROM (SELECT source, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')} <> '') AS l FROM ({source}) WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)"


query("paragraph_explode", paragraphs_sql(_DOCS))(lambda spark, folder: S.paragraphs(_documents(spark, folder)))


_REST = strip(r"regexp_replace(paragraph, '^[^\n]*', '')")


@query("section_classify", f"SELECT source, para_index, paragraph, starts_with(paragraph, '### **') AS is_header, CASE WHEN starts_with(paragraph, '### **') THEN string_split(paragraph, chr(10))[1] END AS header, CASE WHEN starts_with(paragraph, '### **') THEN {_REST} ELSE paragraph END AS body FROM ({paragraphs_sql(_DOCS)})")
def section_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of documents as headers and bodies of timestamped sections."""
    return S.section_parts(S.paragraphs(_documents(spark, folder)))


@query("script_word_count", f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`\\n]*`', '', 'g') AS p FROM documents),
o AS (SELECT doc_id, p, regexp_replace(regexp_replace(p, '[\\x{{4e00}}-\\x{{9fff}}]', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\t-\\r\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x1c-\\x1f]', ' ', 'g') AS o FROM t),
n AS (SELECT doc_id, CAST(length(p) - length(regexp_replace(p, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS BIGINT) AS cjk_chars, CAST(len(list_filter(string_split_regex(o, '{W}+'), lambda w: w <> '')) AS BIGINT) AS other_words FROM o)
SELECT doc_id, cjk_chars, other_words, cjk_chars + other_words AS total FROM n""")
def script_word_count(spark: SparkSession, folder: str) -> DataFrame:
    """Han characters and other words of documents."""
    return stats.script_counts(table(spark, folder, "documents"), "doc_id", "text")


@query("format_timestamp_ms", f"WITH {SEGMENTS} SELECT source, seg_no, {clock('start_ms')} AS start_text, {clock('end_ms * 97')} AS late_text FROM sg")
def format_timestamp_ms(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds as clock times."""
    return T.segments(spark, folder).select("source", "seg_no", Z.clock(F.col("start_ms")).alias("start_text"), Z.clock(F.col("end_ms") * 97).alias("late_text"))


_PARTS = "string_split(s, ':')"
_N = lambda i: f"TRY_CAST({_PARTS}[{i}] AS BIGINT)"
_HMS = f"WITH {CUES}, t AS (SELECT source, cue_index, string_split(string_split(coalesce(timestamps, ''), ' ')[1], '.')[1] AS s FROM c)"


def _hms(spark: SparkSession, folder: str) -> DataFrame:
    return T.unique_cues(spark, folder).select("source", "cue_index", F.substring_index(F.substring_index(F.coalesce("timestamps", F.lit("")), " ", 1), ".", 1).alias("s"))


@query("parse_hms_strict", f"{_HMS} SELECT source, cue_index, CASE WHEN len({_PARTS}) = 3 THEN {_N(1)} * 3600 + {_N(2)} * 60 + {_N(3)} END AS seconds FROM t")
def parse_hms_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Clock times of just three parts as seconds."""
    return _hms(spark, folder).select("source", "cue_index", Z.strict_seconds(F.col("s")).alias("seconds"))


@query("parse_hms_lenient", f"{_HMS} SELECT source, cue_index, {_N(1)} * 3600 + CASE WHEN len({_PARTS}) > 1 THEN {_N(2)} * 60 ELSE 0 END + CASE WHEN len({_PARTS}) > 2 THEN {_N(3)} ELSE 0 END AS seconds FROM t")
def parse_hms_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """Clock times read from the left as seconds."""
    return _hms(spark, folder).select("source", "cue_index", Z.lenient_seconds(F.col("s")).alias("seconds"))


_CUT = lambda z: f"CASE WHEN contains({z}, '.') THEN string_split({z}, '.')[1] ELSE string_split({z}, ',')[1] END"
_PART = lambda i: f"CASE WHEN contains(timestamps, '-->') THEN {_CUT(strip(f'string_split(timestamps, {chr(39)}-->{chr(39)})[{i}]'))} ELSE timestamps END"


@query("cue_time_range", f'WITH {CUES} SELECT source, cue_index, {_PART(1)} AS "start", {_PART(2)} AS "end" FROM c')
def cue_time_range(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end of cues down to the second."""
    return T.unique_cues(spark, folder).select("source", "cue_index", Z.cue_start(F.col("timestamps")).alias("start"), Z.cue_end(F.col("timestamps")).alias("end"))


@query("trimmed_ranges", f"WITH {CUES} SELECT source, cue_index, {strip('timestamps')} AS \"start\", {strip('content')} AS \"end\" FROM c")
def trimmed_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A range as trimmed strings, without a check."""
    return T.unique_cues(spark, folder).select("source", "cue_index", Z.time_range(F.col("timestamps"), F.col("content")).alias("r")).select("source", "cue_index", "r.*")


@query("clip_segments", f"WITH {SEGMENTS} SELECT source, seg_no, greatest(start_ms, 10000) AS start_ms, least(end_ms, 60000) AS end_ms FROM sg WHERE end_ms > 10000 AND start_ms < 60000")
def clip_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments cut to the time from ten seconds to a minute."""
    return timeline.clipped(T.segments(spark, folder), 10_000, 60_000).select("source", "seg_no", "start_ms", "end_ms")


@query("turns_by_speaker", f"""WITH {SEGMENTS}, g AS (SELECT source, speaker, min(seg_no) AS f, count(*) AS n_turns, string_agg(start_ms || '-' || end_ms, ' ' ORDER BY start_ms, end_ms) AS turns FROM sg GROUP BY 1, 2)
SELECT source, speaker, CAST(row_number() OVER (PARTITION BY source ORDER BY f, speaker) AS BIGINT) AS speaker_order, n_turns, turns FROM g""")
def turns_by_speaker(spark: SparkSession, folder: str) -> DataFrame:
    """Turns by speaker, speakers as first heard."""
    grouped = timeline.turns_by_speaker(T.segments(spark, folder).withColumnRenamed("seg_no", "turn_no"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["start_ms"].cast("string"), F.lit("-"), t["end_ms"].cast("string"))), " ")
    return grouped.select("source", "speaker", "speaker_order", F.size("turns").cast("bigint").alias("n_turns"), text.alias("turns"))


@query("speaker_timeline_rebase", f"WITH {SEGMENTS}, r AS (SELECT *, coalesce(CAST(sum(end_ms - start_ms) OVER (PARTITION BY source, speaker ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS local_start_ms FROM sg) SELECT source, speaker, seg_no AS turn_no, local_start_ms, local_start_ms + end_ms - start_ms AS local_end_ms FROM r")
def speaker_timeline_rebase(spark: SparkSession, folder: str) -> DataFrame:
    """Turns on the time line of their speaker's joined audio."""
    return timeline.rebased(T.segments(spark, folder).withColumnRenamed("seg_no", "turn_no")).select("source", "speaker", "turn_no", "local_start_ms", "local_end_ms")


_LANG = "CASE WHEN starts_with(language, 'zh') THEN 'zh' ELSE language END"


@query("segments_by_language", f"WITH {SEGMENTS} SELECT source, {_LANG} AS language, count(*) AS n_segments, string_agg(start_ms || '-' || end_ms || ':' || coalesce(text, ''), '|' ORDER BY speaker, seg_no) AS segments FROM sg GROUP BY 1, 2")
def segments_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Segments by language, in the order of speakers."""
    rows = T.segments(spark, folder).withColumn("language", X.plain_language(F.col("language"))).withColumn("speaker_order", F.substring("speaker", 2, 9).cast("bigint"))
    grouped = timeline.segments_by_language(rows)
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["start_ms"].cast("string"), F.lit("-"), s["end_ms"].cast("string"), F.lit(":"), F.coalesce(s["text"], F.lit("")))), "|")
    return grouped.select("source", "language", "n_segments", text.alias("segments"))


_ROW = f"chr(10) || {clock('start_ms')} || ' --> ' || {clock('end_ms')} || chr(10)"


@query("render_transcript_vtt", f"WITH {SEGMENTS} SELECT source, 'WEBVTT' || chr(10) || ' ' || string_agg({_ROW} || coalesce(text, ''), ' ' ORDER BY seg_no) AS body FROM sg GROUP BY 1")
def render_transcript_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts as VTT."""
    return R.transcript_vtt(T.segments(spark, folder))


@query("render_language_vtt", f"WITH {SEGMENTS} SELECT source, language, 'WEBVTT' || chr(10) || string_agg({_ROW} || '[' || language || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY seg_no) AS body, source || '_' || language || '.vtt' AS name FROM sg GROUP BY 1, 2")
def render_language_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts as VTT per language, tagged."""
    return R.language_vtt(T.segments(spark, folder))


@query("render_merged_vtt", f"WITH {SEGMENTS} SELECT source, 'WEBVTT' || chr(10) || string_agg({_ROW} || coalesce(text, '') || chr(10), chr(10) ORDER BY language, seg_no) AS body FROM sg GROUP BY 1")
def render_merged_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of all languages as one VTT."""
    return R.language_vtt(T.segments(spark, folder), tagged=False)


_CSV = lambda x: f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END"

query("cue_csv", f"WITH {CUES} SELECT source, ',Timestamps,Content' || chr(10) || string_agg(cue_index || ',' || {_CSV('timestamps')} || ',' || {_CSV('content')}, chr(10) ORDER BY cue_index) || chr(10) AS body FROM c GROUP BY 1")(lambda spark, folder: R.cue_csv(T.unique_cues(spark, folder)))
query("cue_csv_plain", f"WITH {CUES} SELECT source, 'Timestamps,Content' || chr(10) || string_agg({_CSV('timestamps')} || ',' || {_CSV('content')}, chr(10) ORDER BY cue_index) || chr(10) AS body FROM c GROUP BY 1")(lambda spark, folder: R.cue_csv(T.unique_cues(spark, folder), index=False))


_NAME = "regexp_extract(file_path, '([^/]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^\\.*[^.].*\\.([^.]*)$', 1))"
_URL = "(starts_with(file_path, 'http://') OR starts_with(file_path, 'https://') OR starts_with(file_path, 'www.'))"
_KIND = f"CASE WHEN {_URL} THEN 'url' WHEN regexp_matches(lower(file_path), '\\.({_MEDIA})\\z') THEN 'media' WHEN regexp_matches(lower(file_path), '\\.({_TEXTS})\\z') THEN 'text' ELSE 'unsupported' END"
_FILES = "(SELECT DISTINCT file_id, CASE WHEN file_id % 5 = 0 THEN 'https://media.example' || file_path WHEN file_id % 7 = 0 THEN file_path || '.WAV' WHEN file_id % 11 = 0 THEN '/a/.hidden' ELSE file_path END AS file_path FROM files WHERE file_id IS NOT NULL)"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    n, path = F.col("file_id"), F.col("file_path")
    changed = F.when(n % 5 == 0, F.concat(F.lit("https://media.example"), path)).when(n % 7 == 0, F.concat(path, F.lit(".WAV"))).when(n % 11 == 0, "/a/.hidden").otherwise(path)
    return table(spark, folder, "files").where("file_id is not null").select("file_id", changed.alias("file_path")).distinct()


@query("classify_inputs", f"SELECT file_id, file_path, {_KIND} AS kind, {_URL} AS is_url, {_SUFFIX} IN {_BATCH} AS batch_media, {_SUFFIX} AS suffix, regexp_replace({_NAME}, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS base_name FROM {_FILES}")
def classify_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs by kind, with suffix and base name."""
    path = F.col("file_path")
    return _files(spark, folder).select("file_id", "file_path", X.input_kind(path).alias("kind"), X.is_url(path).alias("is_url"), X.is_batch_media(path).alias("batch_media"), X.suffix(path).alias("suffix"), X.base_name(path).alias("base_name"))


@query("natural_sort_sources", f"SELECT file_id, CAST(row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all({_NAME}, '(\\d+|\\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\\d') THEN chr(1) || lpad(CAST(length(regexp_replace(t, '^0+(\\d)', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(t, '^0+(\\d)', '\\1') ELSE t END), ''), file_id) AS BIGINT) AS place FROM {_FILES}")
def natural_sort_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The place of files in natural order of their names."""
    keyed = _files(spark, folder).withColumn("k", X.natural_key(F.regexp_extract("file_path", r"([^/]*)$", 1)))
    return _ranked(keyed)


def _ranked(keyed: DataFrame) -> DataFrame:
    """Ranks by k and file_id without gathering all rows in one task: ranges of a sort are numbered on
    their own, behind the sizes of those before."""
    spark = keyed.sparkSession
    ordered = keyed.repartitionByRange("k", "file_id").sortWithinPartitions("k", "file_id").select("file_id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("inner_no"))
    kept = checkpoint(ordered)
    sizes = {r.part: r.n for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(rows, "part int, before bigint")
    return kept.join(F.broadcast(offsets), "part").select("file_id", (F.col("before") + F.col("inner_no") + 1).alias("place"))


@query("route_inputs", f"SELECT file_id, {_KIND} AS kind, CASE WHEN {_KIND} IN ('url', 'media') THEN 'transcript' WHEN {_KIND} = 'text' AND {_SUFFIX} IN ('docx', 'txt', 'md') THEN 'academic' END AS route, CASE WHEN {_KIND} = 'unsupported' THEN 'unsupported input' WHEN {_KIND} = 'text' AND {_SUFFIX} NOT IN ('docx', 'txt', 'md') THEN 'no route for this type' END AS error FROM {_FILES}")
def route_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs by where they go."""
    return J.routed(_files(spark, folder), "file_path").select("file_id", "kind", "route", "error")


@query("route_by_language", f"WITH {TRANSLATIONS}, d AS (SELECT *, {detected_sql('paragraph')} AS language FROM p) SELECT source, para_index, language, target, CASE WHEN language = 'zh' AND lower(target) = 'chinese' THEN 'rewrite' ELSE 'translate' END AS route FROM d")
def route_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by the language heard and the one wanted: rewrite or translate."""
    heard = M.detect_languages(T.translation_paragraphs(spark, folder), ScriptDetector(), "paragraph")
    return heard.select("source", "para_index", "language", "target", J.transcript_route(F.col("language"), F.col("target")).alias("route"))


@query("chosen_inputs", f"SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'https://x.example/' || file_id ELSE file_path END AS input FROM {_FILES}")
def chosen_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses before files where both are given."""
    n = F.col("file_id")
    url = F.when(n % 3 == 0, F.concat(F.lit(" https://x.example/"), n.cast("string"))).when(n % 3 == 1, "  ")
    return _files(spark, folder).select("file_id", J.chosen_input(F.col("file_path"), url).alias("input"))


_JOB_FILES = "(SELECT DISTINCT file_id, channel_id, file_path, model_size FROM files WHERE file_id IS NOT NULL)"
_BASE = "regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1')"
_ITEMS = f"""f AS (SELECT *, coalesce(channel_id, -1) * 1000000 + file_id // 8 AS job_id FROM {_JOB_FILES}),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_id) - 1 AS input_no, CASE WHEN file_id % 3 = 0 THEN coalesce(model_size, 'large-v3') WHEN channel_id % 2 = 0 THEN 'base' ELSE 'large-v3' END AS transcribe_model FROM f),
items AS (SELECT job_id, input_no, CAST(NULL AS BIGINT) AS segment_no, file_path AS input, CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS end_time, CAST(NULL AS VARCHAR) AS output_wav, CASE WHEN file_id % 4 = 1 THEN 'File ' || file_id ELSE {_BASE} END AS title, transcribe_model, CASE WHEN file_id % 3 = 0 THEN '5' END AS chunk_length, './out' AS output_dir FROM n WHERE file_id % 2 <> 0
UNION ALL SELECT job_id, input_no, 0, file_path, '00:00:05', '00:01:00', NULL, 'Segment 1', transcribe_model, CASE WHEN file_id % 3 = 0 THEN '5' END, './out' FROM n WHERE file_id % 2 = 0
UNION ALL SELECT job_id, input_no, 1, file_path, '00:01:00', '00:02:00', 'part.wav', 'part of ' || file_id, transcribe_model, CASE WHEN file_id % 3 = 0 THEN '5' END, './out' FROM n WHERE file_id % 2 = 0)"""


@query("expand_jobs", f"WITH {_ITEMS} SELECT * FROM items")
def expand_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of several inputs as work items with their settings and titles."""
    items = J.expand_jobs(T.channel_jobs(spark, folder))
    return items.withColumn("chunk_length", F.col("settings")["chunk_length"]).drop("settings")


@query("job_documents", f"""WITH {_ITEMS}, r AS (SELECT *, CASE WHEN (input_no + coalesce(segment_no, 0)) % 3 = 1 THEN '' ELSE 'done ' || input END AS text, CASE WHEN input_no % 5 = 3 THEN '' WHEN input_no % 5 = 4 THEN NULL ELSE input END AS base_name FROM items)
SELECT job_id, string_agg('# ' || title || chr(10) || chr(10) || text, chr(10) || '---' || chr(10) || chr(10) ORDER BY input_no, coalesce(segment_no, -1)) AS body FROM r WHERE text <> '' AND base_name <> '' GROUP BY 1""")
def job_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Results of work items, those without text or base name left out, in a document a job."""
    items = J.expand_jobs(T.channel_jobs(spark, folder))
    n, s = F.col("input_no"), F.coalesce("segment_no", F.lit(0))
    results = items.select("job_id", "input_no", "segment_no", F.when((n + s) % 3 == 1, "").otherwise(F.concat(F.lit("done "), "input")).alias("text"), F.when(n % 5 == 3, "").when(n % 5 == 4, None).otherwise(F.col("input")).alias("base_name"))
    return J.job_documents(items, results)


@query("clip_names", f"""SELECT file_id, CASE WHEN file_id % 2 = 0 AND file_id % 3 = 0 THEN 'cut.wav' WHEN file_id % 2 = 0 THEN {_BASE} || '_00:00:05-00:01:00.wav' ELSE {_BASE} || '.wav' END AS name FROM {_JOB_FILES}""")
def clip_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of audio cut from inputs."""
    files = table(spark, folder, "files").where("file_id is not null").select("file_id", "file_path").distinct()
    ranged, n = F.col("file_id") % 2 == 0, F.col("file_id")
    return files.select("file_id", J.clip_name(F.col("file_path"), F.when(ranged, "00:00:05"), F.when(ranged, "00:01:00"), F.when(n % 3 == 0, "cut.mp3")).alias("name"))


@query("kept_results", f"WITH {PAIRS} SELECT source, para_index FROM p WHERE coalesce(answer, '') <> '' AND coalesce(CASE WHEN para_index % 7 = 0 THEN '' WHEN para_index % 11 = 0 THEN NULL ELSE CAST(source AS VARCHAR) END, '') <> ''")
def kept_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results that have a text and a base name."""
    n = F.col("para_index")
    rows = T.rewrite_paragraphs(spark, folder).select("source", n, F.col("answer").alias("text"), F.when(n % 7 == 0, "").when(n % 11 == 0, None).otherwise(F.col("source").cast("string")).alias("base_name"))
    return J.kept_results(rows).select("source", "para_index")


_ECHO = lambda task, lang: f"CASE WHEN {strip('paragraph')} = '' THEN paragraph ELSE '[{task}:{lang}] ' || paragraph END"


@query("translate_bilingual", f"WITH {TRANSLATIONS} SELECT source, string_agg('# English' || chr(10) || paragraph || chr(10) || chr(10) || '# Chinese' || chr(10) || {_ECHO('translate', 'Chinese')} || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY para_index) AS body FROM p GROUP BY 1")
def translate_bilingual(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs beside their translations by the stand-in model."""
    return R.bilingual_markdown(M.model_map(T.translation_paragraphs(spark, folder), EchoModel(), "translate", "Chinese"), "Chinese")


for _task, _language in (("rewrite", "Chinese"), ("academic", "English")):
    query(f"{_task}_markdown", f"WITH {PAIRS} SELECT source, string_agg({_ECHO(_task, _language)}, chr(10) || chr(10) ORDER BY para_index) AS body FROM p GROUP BY 1")(
        lambda spark, folder, task=_task, language=_language: R.plain_markdown(M.model_map(T.rewrite_paragraphs(spark, folder), EchoModel(), task, language))
    )


@query("translate_cited", f"""WITH s AS (SELECT *, starts_with(paragraph, '### **') AS h FROM ({paragraphs_sql(_SECTIONS)}))
SELECT source, string_agg(CASE WHEN h THEN paragraph || chr(10) || chr(10) || '---' || chr(10) ELSE '# Original' || chr(10) || paragraph || chr(10) || chr(10) || '# Chinese' || chr(10) || '[translate:Chinese] ' || paragraph || chr(10) || chr(10) || '---' || chr(10) END, chr(10) ORDER BY para_index) AS body FROM s GROUP BY 1""")
def translate_cited(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamped sections beside their translations."""
    parts = S.section_parts(S.paragraphs(_sections(spark, folder)))
    return R.cited_bilingual_markdown(M.model_map(parts, EchoModel(), "translate", "Chinese"), "Chinese")


@query("combine_markdown_job", f"WITH {PAIRS} SELECT source, string_agg('# ' || 'Segment ' || para_index || chr(10) || chr(10) || answer, chr(10) || '---' || chr(10) || chr(10) ORDER BY para_index) AS body FROM p WHERE answer IS NOT NULL GROUP BY 1")
def combine_markdown_job(spark: SparkSession, folder: str) -> DataFrame:
    """Titled results of a job in one document."""
    rows = T.rewrite_paragraphs(spark, folder).where("answer is not null")
    return R.job_document(rows.select("source", F.col("para_index").alias("ordinal"), F.concat(F.lit("Segment "), F.col("para_index").cast("string")).alias("title"), F.col("answer").alias("content")), "source")


@query("combine_markdown_batch", f"WITH {PAIRS} SELECT source, string_agg('## ' || para_index || '_rewritten.md' || chr(10) || chr(10) || answer || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY para_index) AS body FROM p WHERE answer IS NOT NULL GROUP BY 1")
def combine_markdown_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a batch in one document, in natural order."""
    rows = T.rewrite_paragraphs(spark, folder).where("answer is not null").withColumn("name", F.concat(F.col("para_index").cast("string"), F.lit("_rewritten.md")))
    return R.batch_document(rows.select("source", X.natural_key(F.col("name")).alias("k"), "name", F.col("answer").alias("content")), "source", "k")


@query("compare_reports")
def compare_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Rewritings compared with their sources word by word."""
    rows = T.rewrite_paragraphs(spark, folder).select(F.col("para_index").alias("source"), "paragraph", "answer")
    return R.compare_report(M.compared(rows, "paragraph", "answer").select("source", "diff"))


@query("string_functions", f"""WITH {CUES} SELECT source, cue_index, {strip('content')} AS stripped, {complete('content')} AS completed, CASE WHEN regexp_matches(content, '{_ENDS}\\z') THEN content ELSE content || '。' END AS stopped, regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`\\n]*`', '', 'g') AS uncoded, regexp_matches(content, '{_MARKS}') AS cjk FROM c WHERE content IS NOT NULL""")
def string_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions on the contents of cues."""
    c = F.col("content")
    return T.unique_cues(spark, folder).where(c.isNotNull()).select("source", "cue_index", X.strip(c).alias("stripped"), X.complete(c).alias("completed"), X.with_full_stop(c).alias("stopped"), X.without_code(c).alias("uncoded"), c.rlike(X.CJK_MARKS).alias("cjk"))


@query("model_names", "SELECT DISTINCT pair_id, CASE WHEN contains(llm, '/') THEN regexp_replace(llm, '^[^/]*/', '') ELSE llm END AS model FROM translations")
def model_names(spark: SparkSession, folder: str) -> DataFrame:
    """Models without their providers."""
    return table(spark, folder, "translations").select("pair_id", X.model_name(F.col("llm")).alias("model")).distinct()


@query("model_failures", f"WITH {PAIRS} SELECT source, para_index, CASE WHEN {strip('paragraph')} = '' THEN paragraph WHEN contains(paragraph, '7') THEN NULL ELSE '[rewrite:English] ' || paragraph END AS answer, CASE WHEN {strip('paragraph')} = '' THEN 'skipped' WHEN contains(paragraph, '7') THEN 'error' ELSE 'ok' END AS status, CASE WHEN contains(paragraph, '7') THEN 'RuntimeError: the model failed' END AS error FROM p")
def model_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A model that fails on some paragraphs: these have an error, all others their answers."""
    return M.model_map(T.rewrite_paragraphs(spark, folder).drop("answer"), FailingModel(EchoModel(), "7"), "rewrite", "English").select("source", "para_index", "answer", "status", "error")


@query("model_settings", f"WITH {PAIRS} SELECT source, para_index, CASE WHEN {strip('paragraph')} = '' THEN paragraph ELSE '[openai gpt-4 5000 600 0.2] ' || paragraph END AS answer FROM p")
def model_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings as they reach the model."""
    settings = ModelSettings("openai/gpt-4", 5000, 600, 0.2)
    return M.model_map(T.rewrite_paragraphs(spark, folder).drop("answer"), SettingsModel(), "rewrite", "English", settings=settings).select("source", "para_index", "answer")


_MEDIA_ROWS = "m AS (SELECT '/m/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.wav' ELSE '.mp3' END AS source, text FROM documents), l AS (SELECT source, i, string_split(text, chr(10))[i] AS line FROM m, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))"
_HAN = "CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END"
_SILENT = "regexp_replace(text, '[\\t\\n\\x0b\\f\\r ]', '', 'g') = ''"


@query("transcribe_files", f"""WITH {_MEDIA_ROWS} SELECT source, {_HAN.replace('text', 'm.text')} AS language, l.i AS seg_no, 2000 * (l.i - 1) AS start_ms, 2000 * l.i AS end_ms, l.line AS text, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM m JOIN l USING (source)
UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, 'error', 'no content' FROM m WHERE text IS NULL""")
def transcribe_files(spark: SparkSession, folder: str) -> DataFrame:
    """Media as segments of text; files that cannot be transcribed have an error."""
    found = M.transcribed(T.text_media(spark, folder), SplitTranscriber())
    said = M.transcript_segments(found).withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    return said.unionByName(found.where("status = 'error'").select("source", "status", "error"), allowMissingColumns=True)


@query("transcript_files_vtt", f"""WITH {_MEDIA_ROWS}, sg AS (SELECT source, i AS seg_no, 2000 * (i - 1) AS start_ms, 2000 * i AS end_ms, line AS text FROM l) SELECT source, 'WEBVTT' || chr(10) || ' ' || string_agg({_ROW} || text, ' ' ORDER BY seg_no) AS body FROM sg GROUP BY 1""")
def transcript_files_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """Media transcribed and written as VTT."""
    return R.transcript_vtt(M.transcript_segments(M.transcribed(T.text_media(spark, folder), SplitTranscriber())))


@query("diarize_files", f"""WITH {_MEDIA_ROWS} SELECT l.source, 'SPEAKER_0' || ((l.i - 1) // 2 % 2) AS speaker, l.i - 1 AS turn_no, 2000 * (l.i - 1) AS start_ms, 2000 * l.i AS end_ms, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM m JOIN l USING (source) WHERE NOT {_SILENT.replace('text', 'm.text')}
UNION ALL SELECT source, NULL, NULL, NULL, NULL, 'error', CASE WHEN text IS NULL THEN 'no content' ELSE 'ValueError: no sound' END FROM m WHERE text IS NULL OR {_SILENT}""")
def diarize_files(spark: SparkSession, folder: str) -> DataFrame:
    """Who speaks when in media; files without sound have an error."""
    return M.diarized(T.text_media(spark, folder), LinesDiarizer())


@query("multi_speaker_segments", f"""WITH {_MEDIA_ROWS}, s AS (SELECT l.source, (l.i - 1) // 2 % 2 AS speaker, l.i, l.line FROM m JOIN l USING (source) WHERE NOT {_SILENT.replace('text', 'm.text')}),
g AS (SELECT *, row_number() OVER (PARTITION BY source, speaker ORDER BY i) AS seg_no, CASE WHEN speaker = 1 THEN 'fr' WHEN bool_or(regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')) OVER (PARTITION BY source, speaker) THEN 'zh' ELSE 'en' END AS language FROM s)
SELECT source, language, count(*) AS n_segments, string_agg((2000 * (seg_no - 1)) || '-' || (2000 * seg_no) || ':' || line, '|' ORDER BY speaker, seg_no) AS segments FROM g GROUP BY 1, 2""")
def multi_speaker_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Media of several speakers: told apart, joined by speaker, transcribed with hints, by language."""
    rows = M.transcribed_by_speaker(T.text_media(spark, folder), LinesDiarizer(), SplitTranscriber(), {"SPEAKER_01": "fr"}, slicer=slice_lines)
    grouped = timeline.segments_by_language(rows.where("status = 'ok'"))
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["start_ms"].cast("string"), F.lit("-"), s["end_ms"].cast("string"), F.lit(":"), s["text"])), "|")
    return grouped.select("source", "language", "n_segments", text.alias("segments"))


_FETCHED = "CASE WHEN file_id % 10 = 0 THEN 'https://x.invalid' || file_path ELSE file_path END"


@query("fetch_inputs", f"SELECT path, CASE WHEN contains(path, '.invalid') THEN NULL ELSE path END AS content, CASE WHEN contains(path, '.invalid') THEN 'error' ELSE 'ok' END AS status, CASE WHEN contains(path, '.invalid') THEN 'OSError: no such host' END AS error FROM (SELECT {_FETCHED} AS path FROM {_FILES}) WHERE starts_with(path, 'http://') OR starts_with(path, 'https://') OR starts_with(path, 'www.')")
def fetch_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Audio of the inputs that are addresses; those that cannot be fetched have an error."""
    path = F.when(F.col("file_id") % 10 == 0, F.concat(F.lit("https://x.invalid"), "file_path")).otherwise(F.col("file_path"))
    urls = _files(spark, folder).select(path.alias("path")).where(X.is_url(F.col("path")))
    return M.fetched(urls, BytesFetcher()).withColumn("content", F.col("content").cast("string"))


@query("decode_media", f"""WITH {_MEDIA_ROWS} SELECT source AS path, CASE WHEN source LIKE '%.wav' THEN text WHEN text <> '' THEN 'mp3:' || text END AS content, CASE WHEN text IS NULL OR (text = '' AND source LIKE '%.mp3') THEN 'error' ELSE 'ok' END AS status, CASE WHEN text IS NULL THEN 'no content' WHEN text = '' AND source LIKE '%.mp3' THEN 'ValueError: nothing to decode' END AS error FROM m""")
def decode_media(spark: SparkSession, folder: str) -> DataFrame:
    """Media files as WAV data."""
    return M.decoded(T.text_media(spark, folder), PlainDecoder()).withColumn("content", F.col("content").cast("string"))


@query("misplaced_flags", f"""SELECT file_id, CASE WHEN {_KIND} NOT IN ('url', 'media') AND g <> '' THEN 'only for media and addresses: ' || g END AS error FROM (SELECT file_id, file_path, concat_ws(', ', CASE WHEN file_id % 2 = 0 THEN '--transcribe-model' END, CASE WHEN file_id % 3 = 0 THEN '--multi-language' END, CASE WHEN file_id % 4 = 1 THEN '--transcribe-lang' END) AS g FROM {_FILES})""")
def misplaced_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Options of transcription given for inputs that are not transcribed."""
    n = F.col("file_id")
    error = J.misplaced_flags(F.col("file_path"), F.when(n % 2 == 0, "tiny").otherwise("large-v3"), n % 3 == 0, F.when(n % 4 == 1, "de"))
    return _files(spark, folder).select("file_id", error.alias("error"))


@query("batch_documents")
def batch_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's media transcribed and rewritten, with an error where a step fails on one of them."""
    return P.media_documents(T.text_media(spark, folder), SplitTranscriber(), FailingModel(EchoModel(), "7"), "rewrite", decoder=PlainDecoder())


@query("docx_texts", f"""WITH b AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g'), chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(array_to_string(l, chr(10)), '') AS text FROM b""")
def docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as DOCX and read again: a paragraph for each block."""
    texts = table(spark, folder, "documents").where("text is not null").select("doc_id", docx_content(F.col("text")).alias("content"))
    return texts.select("doc_id", docx_column(F.col("content"))["body"].alias("text"))


@query("written_subtitles", parse_sql("vtt"))
def written_subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """Subtitle files written to the shared folder, with a byte order mark, and read and parsed again."""
    place = scratch(spark, "subtitles")
    named = T.subtitle_bodies(spark, folder, "vtt").select(F.concat(F.lit("part"), (F.col("source") % 3).cast("string"), F.lit("/"), F.col("source").cast("string"), F.lit(".vtt")).alias("name"), F.concat(F.lit("\ufeff"), "body").alias("body"))
    write_documents(named, place).count()
    cues = C.parse_cues(C.explode_lines(read_subtitles(spark, f"{place}/*/*.vtt")))
    return cues.withColumn("source", F.regexp_extract("source", r"(\d+)\.vtt$", 1).cast("bigint"))


@query("written_batch", f"WITH {PAIRS} SELECT string_agg('## ' || para_index || '_rewritten.md' || chr(10) || chr(10) || answer || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY para_index) AS body FROM p WHERE answer IS NOT NULL")
def written_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Finished documents written to the shared folder, and all in one in natural order."""
    place = scratch(spark, "batch")
    rows = T.rewrite_paragraphs(spark, folder).where("answer is not null")
    named = rows.select(F.concat(F.col("para_index").cast("string"), F.lit("_rewritten.md")).alias("name"), F.col("answer").alias("body"))
    other = rows.select(F.concat(F.col("para_index").cast("string"), F.lit("_academic.md")).alias("name"), F.lit("left out").alias("body"))
    write_documents(named.unionByName(other), place).count()
    found = read_finished(spark, place).withColumns({"name": F.regexp_extract("source", r"([^/]*)$", 1), "all": F.lit(1)})
    return R.batch_document(found.select("all", X.natural_key(F.col("name")).alias("k"), "name", F.col("body").alias("content")), "all", "k").select("body")


@query("written_cue_table", f"WITH {CUES} SELECT source, cue_index, timestamps, content FROM c")
def written_cue_table(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of all files written as CSV, a folder a file, and read again."""
    place = scratch(spark, "cues")
    write_cue_table(T.unique_cues(spark, folder), place)
    return read_cue_table(spark, place)


@query("combine_plain_batch", f"WITH {PAIRS} SELECT source, string_agg('## ' || para_index || '.mp4' || chr(10) || chr(10) || CASE WHEN coalesce(answer, '') <> '' THEN answer || chr(10) || chr(10) ELSE '' END, '' ORDER BY para_index) AS body FROM p GROUP BY 1")
def combine_plain_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a batch in one document without rules; those without content by name only."""
    rows = T.rewrite_paragraphs(spark, folder).withColumn("name", F.concat(F.col("para_index").cast("string"), F.lit(".mp4")))
    return R.plain_batch_document(rows.select("source", X.natural_key(F.col("name")).alias("k"), "name", F.col("answer").alias("content")), "source", "k")


_HEAD = "'# Academic Writing Comparison' || repeat(chr(10), 2) || 'This document shows the changes made during academic rewriting.' || repeat(chr(10), 2) || '## Legend:' || chr(10) || '- **Red text with strikethrough**: Deleted content' || chr(10) || '- **Green text**: Added content' || repeat(chr(10), 2) || '## Comparison:' || repeat(chr(10), 2)"


def _grown(spark: SparkSession, folder: str) -> DataFrame:
    rows = T.rewrite_paragraphs(spark, folder).select(F.col("para_index").alias("source"), X.strip(F.col("paragraph")).alias("before"))
    return M.compared(rows.withColumn("after", F.concat(F.lit("zz "), "before")), "before", "after")


@query("compare_grown", f"WITH {PAIRS} SELECT para_index AS source, {_HEAD} || '**zz** ' || {strip('paragraph')} AS body FROM p")
def compare_grown(spark: SparkSession, folder: str) -> DataFrame:
    """Reports on texts with a word put before them."""
    return R.compare_report(_grown(spark, folder).select("source", "diff"))


@query("compare_documents", f"WITH {PAIRS} SELECT para_index AS source, '# Document Comparison' || repeat(chr(10), 2) || '**Original:** ' || para_index || '.docx' || chr(10) || '**Modified:** new.docx' || chr(10) || '**Date:** 2025-01-02 03:04:05' || repeat(chr(10), 2) || '## Changes' || repeat(chr(10), 2) || '**zz** ' || {strip('paragraph')} AS body FROM p")
def compare_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reports on two documents with their names and a date."""
    rows = _grown(spark, folder).select("source", F.concat(F.col("source").cast("string"), F.lit(".docx")).alias("original"), F.lit("new.docx").alias("modified"), F.lit("2025-01-02 03:04:05").cast("timestamp").alias("date"), "diff")
    return R.documents_report(rows)
