"""String functions on columns: trimming, captions' line classes, punctuation, names and paths.

All are built-in expressions. ``WHITE`` spells white space out, because ``\\s`` means only ASCII to
Java's and RE2's regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ends of lines as a text file has them, and as ``str.splitlines`` knows them in addition.
NEWLINES = r"\r\n|\r|\n"
ALL_NEWLINES = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# The signs of the formats and the punctuation that the operators look for.
CUE_TIMES = r"^\d{2}:\d{2}:\d{2}[,.]\d{3} --> \d{2}:\d{2}:\d{2}[,.]\d{3}"
CUE_TIMES_LOOSE = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"
FRAME_COUNTS = r"^\{\d+\}\{\d+\}"
CJK_MARKS = "[，。？！]"
SENTENCE_ENDS = "[.!?。！？]"
COMPLETE_ENDS = r"[，。？！,.!?]\z"
REPEATED = "\u4e00-\u9fa5。！？；：“”（）【】《》、"
VIDEO_SUFFIXES = ["mp4", "avi", "mov", "mkv", "flv", "wmv", "m4v", "webm"]
AUDIO_SUFFIXES = ["mp3", "flac", "aac", "ogg", "m4a", "opus"]
TEXT_SUFFIXES = ["vtt", "srt", "ass", "ssa", "sub", "smi", "txt", "md", "markdown", "docx"]
BATCH_SUFFIXES = ["mp4", "avi", "mkv", "mov", "wmv", "mp3", "wav", "m4a", "ogg", "flac"]


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def lines_of(text: Column, pattern: str = NEWLINES) -> Column:
    """The lines of a text as an array; a newline at the very end starts no line, an empty text has none."""
    lines = F.split(F.regexp_replace(text, r"^\x{feff}", ""), pattern, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def complete(sentence: Column) -> Column:
    """A sentence with a comma after it unless it ends in punctuation."""
    return F.when(sentence.rlike(COMPLETE_ENDS), sentence).otherwise(F.concat(sentence, F.lit("，")))


def with_full_stop(text: Column) -> Column:
    """A text with a full stop after it unless it ends like a sentence."""
    return F.when(text.rlike(rf"{SENTENCE_ENDS}\z"), text).otherwise(F.concat(text, F.lit("。")))


def bare_sentences(text: Column) -> Column:
    """The sentences of a text without their ends; a text of nothing but ends is one sentence."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_ENDS, -1), strip), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def sentences_of(text: Column, cjk: Column, *, blank: bool = True) -> Column:
    """The sentences of a text with their ends, stripped and completed.

    In CJK mode a terminator ends a sentence wherever it stands, otherwise before white space only.
    A sentence of nothing but white space is a lone comma, or left out unless ``blank``.
    """
    marked = F.when(cjk, F.regexp_replace(text, rf"({SENTENCE_ENDS}\p{{P}}*){WHITE}*", "$1\x01")).otherwise(F.regexp_replace(text, rf"({SENTENCE_ENDS}\p{{P}}*){WHITE}+", "$1\x01"))
    pieces = F.split(marked, "\x01", -1)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(kept if blank else F.filter(kept, lambda x: strip(x) != ""), lambda x: complete(strip(x))))


def collapse_repeats(text: Column) -> Column:
    """A text with phrases of one to five CJK characters said several times in a row said once."""
    return F.regexp_replace(text, rf"([{REPEATED}]{{1,5}})(?:{WHITE}?\1)+", "$1")


def without_code(text: Column) -> Column:
    """A Markdown text without fenced and inline code."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), "`[^`\n]*`", "")


def suffix(path: Column) -> Column:
    """The suffix of a path in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path, keep=True), r"^\.*[^.].*\.([^.]*)$", 1))


def base_name(path: Column, *, keep: bool = False) -> Column:
    """The last part of a path, without its suffix unless ``keep``."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return name if keep else F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def is_url(path: Column) -> Column:
    """Whether an input is an address."""
    return path.startswith("http://") | path.startswith("https://") | path.startswith("www.")


def input_kind(path: Column) -> Column:
    """url, media, text or unsupported, by how an input is written."""
    return F.when(is_url(path), "url").when(_ends_in(path, VIDEO_SUFFIXES + AUDIO_SUFFIXES), "media").when(_ends_in(path, TEXT_SUFFIXES), "text").otherwise("unsupported")


def _ends_in(path: Column, suffixes: list[str]) -> Column:
    """Whether a path ends in a dot and one of the suffixes; nothing need stand before the dot."""
    return F.lower(path).rlike(rf"\.(?:{'|'.join(suffixes)})\z")


def is_batch_media(path: Column) -> Column:
    """Whether the batch takes a file for media."""
    return suffix(path).isin(BATCH_SUFFIXES)


def natural_key(name: Column) -> Column:
    """A sort key by which numbers in names count as numbers, however long: their digits stand behind
    the number of these, and before any other character."""

    def part(t: Column) -> Column:
        digits = F.regexp_replace(t, r"^0+(?=\d)", "")
        return F.when(t.rlike(r"^\d"), F.concat(F.lit("\x01"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), part), "")


def plain_language(code: Column) -> Column:
    """All forms of Chinese as zh; other codes as they are."""
    return F.when(code.startswith("zh"), "zh").otherwise(code)


def model_name(model: Column) -> Column:
    """The part of a model id after its provider."""
    return F.when(model.contains("/"), F.regexp_replace(model, r"^[^/]*/", "")).otherwise(model)
