"""Sentence units of texts in many languages and scripts.

Method: in spaced scripts and those with full stops of their own, every run of terminators is a node
that context accepts or rejects: abbreviations, initials, numbers, file names, quotations, brackets,
and what comes next. Thai, which has neither, is cut at gaps: the likeliest path through the lattice
of all dictionary words tells the words at both sides of a gap, and how often these words end and
begin texts, as final particles and opening words do, tells whether the gap parts sentences.

The dictionary is learned: strings of whole letters (a consonant with its vowels and tones) that
recur and that neither always go on with the same letter nor always follow one, and given words.

Scale: texts are cut in the scan's own partitions. Learning counts strings of at most ``LONGEST``
characters within all Thai texts, and the words at gaps, with partial counts before a small shuffle.
The dictionary sent to all executors holds strings that are at least the share ``RAREST`` of all
letters, so at most 1 / RAREST of each length; the odds of words at gaps hold entries that are at
least that share of all gaps, so at most ``REACH`` / RAREST for each side.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.captions import has_words, parse
from cuemill.llm.streams import to_batches
from cuemill.session import checkpoint

#: Words of an opening or ending at most.
REACH = 3
#: Characters of a dictionary word at most, how often it must occur at least, and at what share of all letters.
LONGEST, FEWEST, RAREST = 12, 5, 1e-5
#: How often a string that goes on with one and the same letter, or follows one, is part of a word.
BOUND = 0.7
#: How many gaps the entry shorter by one word counts for in a longer one's likelihood.
SMOOTHING = 4.0
#: The share of gaps that part sentences where nothing is known, and how many beginnings it counts for.
USUAL_SHARE, SHARE_WEIGHT = 0.3, 20

# Abbreviations that never end a sentence, in lower case without dots.
NEVER_LAST = {
    "dr", "prof", "mr", "mrs", "ms", "st", "mt", "rev", "gen", "col", "sgt", "capt", "hon", "vs", "cf", "eg", "ie", "e.g", "i.e", "approx", "ca", "hr", "fr", "bzw", "vgl", "z", "d", "z. b", "z.b", "d. h", "d.h", "mm", "mme", "mlle", "p. ex", "p.ex", "ex", "sr", "sra", "srta", "ud", "uds", "p. ej", "p.ej", "ej",
    "д-р", "г-н", "г-жа", "проф", "напр", "т. е", "т.е", "им", "тов", "डॉ", "श्री", "प्रो", "ดร", "พ.ศ", "ค.ศ", "นพ", "د", "أ", "ج",
}
# Abbreviations that never end a sentence before a number, in lower case without dots.
BEFORE_NUMBER = {"no", "nos", "fig", "figs", "vol", "ch", "chap", "sec", "pp", "p", "eq", "nr", "abb", "bd", "kap", "str", "s", "art", "núm", "num", "pág", "págs", "cap", "см", "рис", "стр", "гл", "т", "ул", "ч", "सं", "पृ", "रु", "ص", "n.º", "nº"}
# Abbreviations that end a sentence only before a capital, in lower case without dots.
MAY_BE_LAST = {"etc", "usw", "u. a", "u.a", "u. s. w", "inc", "ltd", "co", "corp", "jr", "a.m", "p.m", "a. m", "p. m", "am", "pm", "т. д", "т.д", "т. п", "т.п", "др", "пр", "г", "гг", "в", "вв", "h", "min", "km", "kg", "uhr", "approx", "bros", "dept", "univ", "м", "см", "кг"}
# Verbs of saying after or before which a quotation's sentence goes on.
SAYING = {
    "zh": ["说", "道", "问", "答", "喊", "叫", "写", "称"],
    "ar": ["قال", "قالت", "سأل", "سألت", "أجاب", "أجابت", "كتب", "كتبت", "أضاف", "صاح"],
    "hi": ["कहा", "पूछा", "बोला", "बोली", "लिखा", "बताया"],
    "th": ["พูด", "กล่าว", "ถาม", "บอก", "ตอบ", "เขียน"],
    "en": ["said", "asked", "replied", "answered", "wrote", "says", "asks"],
    "de": ["sagte", "fragte", "antwortete", "schrieb", "meinte", "rief", "sagt", "fragt"],
    "fr": ["dit", "demandé", "demanda", "répondu", "répondit", "écrit", "ajouta", "demande"],
    "es": ["dijo", "preguntó", "respondió", "contestó", "escribió", "dice", "pregunta"],
    "ru": ["сказал", "сказала", "спросил", "спросила", "ответил", "ответила", "написал", "написала", "говорит"],
}
_SAYING_WORDS = frozenset(v for code in ("en", "de", "fr", "es", "ru") for v in SAYING[code])
# Words that go on with a sentence after dots.
GOING_ON = ["或者", "或", "和", "但", "而", "还是", "أو", "و", "ولكن", "या", "और", "लेकिन", "หรือ", "และ", "แต่", "または", "あるいは", "でも", "けど"]

_BLANK_LINES = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+|\r[^\S\r\n]*(?:\r[^\S\r\n]*)+")
_HEADING = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+[^\n\r]*")
_RULE = re.compile(r"\s*[-*_=]{3,}\s*")
_SKIPPED = re.compile(r"https?:/+[!-~]+|<[^<>\n]{1,80}>|\{\\[^{}]*\}|[A-Za-z0-9_-]+(?:[./\\][A-Za-z0-9_-]+)*\.[A-Za-z][A-Za-z0-9]{1,3}(?![A-Za-z0-9])(?=\s|[^\x00-\x7f]|[,;:!?]|$)")
#: What every match of the above holds.
_SKIP_SIGN = re.compile(r"https?:/|<|\{\\|[A-Za-z0-9_-]\.[A-Za-z]")
_FILE = re.compile(r"[A-Za-z0-9_-]*[a-z0-9_-]\.(?:[a-z]\w*\.)*(?:mp4|mp3|wav|vtt|srt|txt|md|docx?|csv|json|ya?ml|pdf|html?|py|mkv|mov)$", re.I)
_TERMINATORS = regex.compile(r"[.!?…。！？؟।۔｡]+")
_CLOSING = "\"'”’»」』)）]】〕›*_~`"
_OPENING = "\"'“„‘«「『(（[【〔‹¿¡*_~`"
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“"}
_QUOTES = re.compile("[" + re.escape("".join(sorted({*_PAIRS, *_PAIRS.values(), '"'}))) + "]")
_BRACKETS = frozenset("(（[【")
#: The end of a clause: a terminator that is not within a number or name.
_CLAUSE_END = regex.compile(r"[!?…。！？؟।۔]|\.(?=\s|$|[\"'”’»])")
#: Searched from the end of a text.
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’-]*$")
_ABBREVIATION_BEFORE = regex.compile(r"(?r)(?:\p{L}\p{M}*\.\s?)+\p{L}\p{M}*$|[\p{L}\p{M}-]+$")
_SPEECH_LEAD = regex.compile(r"[:：]\s*[*_~]*$")
_THAI = re.compile(r"[฀-๿]")
_GAP = re.compile(r"[^\S\n]+|[^\S\n]*\n[^\S\n]*")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_LATIN_WORDS = re.compile(r"[A-Za-z]+")
_THAI_RUN = re.compile(r"[฀-๿]+")
#: Whole Thai letters: vowels written before a consonant, it, and what is written above, below or behind.
_THAI_LETTER = re.compile("[\u0e40-\u0e44]*[^\u0e40-\u0e44][\u0e30-\u0e3a\u0e45-\u0e4e]*|[\u0e40-\u0e44]+")
_PIECE = re.compile(r"[฀-๿]+|\s+|.", re.S)


class Gaps(NamedTuple):
    """Costs of dictionary words, and log odds that a gap before an opening, or after an ending, parts
    sentences, by entry: the words next to the gap first, each with a bar behind."""

    words: dict[str, float]
    openings: dict[str, float]
    endings: dict[str, float]
    prior: float


NO_GAPS = Gaps({}, {}, {}, 0.0)


def _thai_letters(run: str) -> list[int]:
    """Where the whole letters of a Thai text end."""
    return [m.end() for m in _THAI_LETTER.finditer(run)]


def words_of(run: str, costs: dict[str, float]) -> list[str]:
    """The words along the cheapest path through the lattice of a Thai text without spaces. Its nodes are
    the places between whole letters, its arcs the dictionary's words, and letters that are in no word;
    of paths that cost the same the one with the longer first words is taken."""
    ends = [0, *_thai_letters(run)]
    unknown = costs.get("", 20.0)
    n = len(ends)
    best = [0.0] * n
    step = [0] * n
    for i in range(n - 2, -1, -1):
        begin = ends[i]
        cheapest, to = unknown + best[i + 1], i + 1
        for j in range(i + 1, n):
            if ends[j] - begin > LONGEST:
                break
            cost = costs.get(run[begin : ends[j]])
            if cost is not None and cost + best[j] <= cheapest:
                cheapest, to = cost + best[j], j
        best[i], step[i] = cheapest, to
    out, i = [], 0
    while i < n - 1:
        out.append(run[ends[i] : ends[step[i]]])
        i = step[i]
    return out


def _shape(text: str) -> str:
    """A text with each number as 0 and each Latin word as a."""
    return _LATIN_WORDS.sub("a", _DIGITS.sub("0", text))


def _near_gap(before: str, after: str, words: dict[str, float]) -> tuple[list[str], list[str]]:
    """The words at both sides of a gap, those next to it first, at most ``REACH`` at each. They are
    found in the text up to the next gap, and beyond it if it holds fewer."""
    left: list[str] = []
    right: list[str] = []
    for piece in reversed(_PIECE.findall(_shape(before[-120:]))):
        left += reversed(words_of(piece, words)) if _THAI.match(piece) else [piece.strip() or " "]
        if len(left) >= REACH:
            break
    for match in _PIECE.finditer(_shape(after[:120])):
        piece = match.group()
        right += words_of(piece, words) if _THAI.match(piece) else [piece.strip() or " "]
        if len(right) >= REACH:
            break
    return left[:REACH], right[:REACH]


def _quotes(block: str) -> list[tuple[int, int, str]]:
    """Matched quotations and brackets as (open, close, mark), by opening place."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int, str]] = []
    straight = -1
    for met in _QUOTES.finditer(block):
        i, c = met.start(), met.group()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                found.append((straight, i, '"'))
                straight = -1
            continue
        if stack and c == _PAIRS[stack[-1][0]]:
            mark, at = stack.pop()
            found.append((at, i, mark))
        elif c in _PAIRS:
            stack.append((c, i))
        elif c in ")）]】」』»”":
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS[stack[k][0]] == c:
                    found.append((stack[k][1], i, stack[k][0]))
                    del stack[k:]
                    break
    found.sort()
    return found


def _abbreviation(before: str) -> str:
    match = _ABBREVIATION_BEFORE.search(before)
    return match.group().lower() if match else ""


def _said_after(rest: str) -> bool:
    """Whether the words after a quotation say who said it."""
    clause = _TERMINATORS.split(rest, 1)[0].strip()
    if not clause:
        return False
    if clause[0] >= "⺀":
        return clause.startswith(("と", "って", "とい")) or (len(clause) <= 12 and any(clause.endswith(v) for v in SAYING["zh"]))
    words = clause.split()
    if _THAI.match(clause):
        return any(words[0].endswith(v) or v in words[0][:16] for v in SAYING["th"])
    if "؀" <= clause[0] <= "ۿ":
        return words[0] in SAYING["ar"]
    if "ऀ" <= clause[0] <= "ॿ":
        return len(words) <= 6 and words[-1] in SAYING["hi"]
    if clause[0].islower():
        return any(w.strip(",;") in _SAYING_WORDS for w in words[:3])
    return len(words) <= 3 and any(w.lower() in _SAYING_WORDS for w in words[1:])


def _only_lead(unit: str) -> bool:
    """Whether a unit holds nothing but label, markup, annotations and fillers so far."""
    plain = unit.strip(" \t\r\n*_~\"'“„«「『(（¿¡.…!?")
    if len(plain) > 40:
        return False
    return not plain or not has_words(parse(unit + " ").text)


def _cased(block: str) -> bool:
    """Whether small letters at a start mean anything: not in a text of an alphabet with capitals that
    uses none, leaving label and markup aside."""
    if block.upper() == block:
        return True
    said = parse(block).text
    if any(map(str.isupper, said)):
        return True
    small = sum(map(str.islower, said))
    return small < 0.5 * sum(map(str.isalpha, said))


def _stop(block: str, begin: int, end: int, start: int, inside: tuple[int, int, str] | None, cased: bool) -> int:
    """Where the sentence ends that may end with the terminators ``block[begin:end]``: behind the marks
    that close with them, or -1 if it goes on. ``start`` is where its unit starts, ``inside`` the
    quotation or bracket around the terminators."""
    marks = block[begin:end]
    after = end
    closed_quote = False
    while after < len(block):
        if inside is not None and after <= inside[1] and not block[after : inside[1]].strip():
            after = inside[1]
            if inside[2] in _BRACKETS:
                after += 1
                return after if not block[after:].strip() and inside[0] == start else -1
            closed_quote = True
            inside = None
        elif block[after] not in _CLOSING or (block[after] in "\"'" and not closed_quote and after + 1 < len(block) and not block[after + 1].isspace() and block[after + 1] not in _CLOSING):
            break
        after += 1
    return after if _ends(block, begin, after, start, marks, closed_quote, inside, cased) else -1


def _ends(block: str, begin: int, after: int, start: int, marks: str, closed_quote: bool, inside: tuple[int, int, str] | None, cased: bool) -> bool:
    rest = block[after:]
    if not rest.strip():
        return True
    if inside is not None:
        return False
    if _only_lead(block[start:begin]):
        return False
    spaced = rest[0].isspace()
    follow = rest.lstrip()
    head = follow.lstrip(_OPENING + " ")
    first = head[:1]
    if follow[:1] in "(（" and (close := follow.find(")" if follow[0] == "(" else "）")) >= 0 and not follow[close + 1 :].strip():
        return False
    if closed_quote:
        return not (follow[:1] in ",，、;；:：" or _said_after(follow) or (first.islower() and not cased))
    if follow[:1] in ",，、;；:：-–—" and not regex.match(r"[-–—]\s", follow):
        return False
    last = marks[-1]
    dots = marks.endswith("..") or last == "…"
    if first.islower() and (not spaced or not cased):
        return False
    if not dots and last in "。！？।؟۔｡":
        return True
    if dots:
        if not spaced and first.isascii() and not first.isupper():
            return follow[:1] in _OPENING and first.isupper()
        if any(head.startswith(w) and (w[0] >= "⺀" or not head[len(w) : len(w) + 1].isalnum()) for w in GOING_ON):
            return False
        clause = _CLAUSE_END.split(head, 1)[0]
        if first.islower():
            return len(clause.split()) > 4
        return not (first >= "⺀" and len(clause) <= 6)
    if last in "!?":
        return spaced or first.isupper() or not first.isascii() or follow[:1] in _OPENING
    before = block[start:begin]
    word = _WORD_BEFORE.search(before)
    token = word.group() if word else ""
    plain = token.lower()
    abbreviation = _abbreviation(before)
    capital = first.isupper() or follow[:1] in _OPENING or (first.lower() == first.upper() and not first.isdigit())
    if not token:
        return before[-1:] in _CLOSING and (spaced or capital)
    if _THAI.match(token[-1]):
        return False
    if (abbreviation in MAY_BE_LAST or plain in MAY_BE_LAST) and abbreviation not in NEVER_LAST:
        return capital or (spaced and first.isdigit())
    if abbreviation in NEVER_LAST or plain in NEVER_LAST or ((abbreviation in BEFORE_NUMBER or plain in BEFORE_NUMBER) and first.isdigit()):
        return False
    if token in ("م", "ص") and regex.search(r"\d\s*\p{L}$", before):
        return True
    if len(token) == 1 and token.isalpha():
        return False
    if not spaced:
        if first.isdigit() or not capital:
            return False
        if not first.isascii() and first.lower() == first.upper() and token[-1] < "\x80" and not token[-1].isdigit() and follow[:1] not in _OPENING:
            return False
    if "ऀ" <= token[0] <= "ॿ":
        return len(token) > 3
    if first.islower():
        return len(token) >= 3 or token.isdigit()
    return not (token.isdigit() and len(token) <= 3 and _only_lead(block[start : begin - len(token)]))


def _block_spans(block: str, gaps: Gaps) -> Iterator[tuple[int, int]]:
    quotes = _quotes(block)
    skipped = [] if not _SKIP_SIGN.search(block) else [m.span() for m in _SKIPPED.finditer(block) if m.group()[0] in "<{" or m.group().startswith("http") or _FILE.search(m.group())]
    skip_starts = [s for s, _ in skipped]

    opened: list[tuple[int, int, str]] = []
    met = 0

    def around(i: int) -> tuple[int, int, str] | None:
        """The innermost quotation or bracket around a place; places come in order."""
        nonlocal met
        while met < len(quotes) and quotes[met][0] < i:
            while opened and opened[-1][1] <= quotes[met][0]:
                opened.pop()
            opened.append(quotes[met])
            met += 1
        while opened and opened[-1][1] <= i:
            opened.pop()
        return opened[-1] if opened else None

    thai = _THAI.search(block) is not None
    cased = _cased(block)
    cuts: list[tuple[int, int, str]] = [(m.start(), m.end(), ".") for m in _TERMINATORS.finditer(block)]
    if thai and gaps.openings:
        cuts += [(m.start(), m.end(), " ") for m in _GAP.finditer(block)]
        cuts.sort()
    start = 0
    while start < len(block) and block[start].isspace():
        start += 1
    for begin, end, kind in cuts:
        if begin < start:
            continue
        if kind == ".":
            k = bisect_right(skip_starts, begin) - 1
            if k >= 0 and begin < skipped[k][1] - (end - begin if end == skipped[k][1] and block[begin] == "." else 0):
                continue
            stop = _stop(block, begin, end, start, around(begin), cased)
            if stop < 0:
                continue
        else:
            before, after = block[start:begin], block[end:]
            if not after.strip() or not before.strip() or around(begin) is not None or _only_lead(before):
                continue
            if not (_THAI.search(before[-12:]) or _THAI.match(after.lstrip(_OPENING)[:1] or " ") or before[-1:].isdigit()):
                continue
            if _thai_odds(block[max(0, start - 0) : begin], after, gaps) <= 0 or (before[-1:] in "”\"»" and _said_after(after)):
                continue
            stop = begin
        yield start, stop
        start = stop
        while start < len(block) and block[start].isspace():
            start += 1
    tail = len(block.rstrip())
    if start < tail:
        yield start, tail


def _thai_odds(before: str, after: str, gaps: Gaps) -> float:
    """Log odds that the gap between two texts parts sentences."""
    left, right = _near_gap(before, after, gaps.words)
    opening = next((gaps.openings[e] for e in reversed(_forms(right)) if e in gaps.openings), -0.5)
    ending = next((gaps.endings[e] for e in reversed(_forms(left)) if e in gaps.endings), -0.5)
    return gaps.prior + opening + ending


def _forms(words: list[str]) -> list[str]:
    """One, two and more of the words next to a gap as entries."""
    return ["".join(f"{w}|" for w in words[:k]) for k in range(1, len(words) + 1)]


def sentence_spans(text: str | None, gaps: Gaps = NO_GAPS) -> list[tuple[int, int]]:
    """First and last character (from 1, both inclusive, in code points) of every unit of a text.

    Null, empty and white texts have none. Units are in order, do not overlap and leave out only white
    space between them.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []

    def block(begin: int, end: int) -> None:
        for a, b in _block_spans(text[begin:end], gaps):
            out.append((begin + a + 1, begin + b))

    begin = 0
    for blank in [*(m.span() for m in _BLANK_LINES.finditer(text)), (len(text), len(text))]:
        end = blank[0]
        while begin < end:
            heading = _HEADING.match(text, begin, end)
            if not heading:
                break
            piece = text[begin : heading.end()]
            lead = len(piece) - len(piece.lstrip())
            out.append((begin + lead + 1, begin + len(piece.rstrip())))
            begin = heading.end()
            while begin < end and text[begin] in "\r\n":
                begin += 1
        if begin < end and text[begin:end].strip():
            block(begin, end)
        begin = blank[1]
    return out


def _thai_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The mostly Thai parts of texts between blank lines, without label, markup and annotations."""
    for batch in batches:
        for content in batch.column(0).to_pylist():
            for part in _BLANK_LINES.split(content):
                said = parse(part.strip()).text.strip()
                if len(said) >= 4 and _THAI.search(said) and len(_THAI.findall(said)) >= 0.4 * len(said):
                    yield said


def _counted(rows: Iterable[tuple[Iterable[tuple], int]], schema: pa.Schema, limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Keys and their numbers as batches, added up before as far as ``limit`` keys fit in memory."""
    seen: Counter = Counter()
    for keys, n in rows:
        for key in keys:
            seen[key] += n
        if len(seen) > limit:
            yield from to_batches(((*key, n) for key, n in seen.items()), schema)
            seen.clear()
    yield from to_batches(((*key, n) for key, n in seen.items()), schema)


def _strings(run: str) -> Iterator[tuple[str, str, str]]:
    """Every string of whole letters of a Thai text, with itself without its last letter and without its
    first one. Strings of one letter more than words have are there to tell how words go on."""
    ends = [0, *_thai_letters(run)]
    for i in range(len(ends) - 1):
        for j in range(i + 1, len(ends)):
            yield run[ends[i] : ends[j]], run[ends[i] : ends[j - 1]], run[ends[i + 1] : ends[j]]
            if ends[j] - ends[i] > LONGEST:
                break


def learn_words(thai: DataFrame, given: Iterable[str] = ()) -> dict[str, float]:
    """The cost of each dictionary word, minus the logarithm of its share of all letters, from a frame
    of Thai texts (text); the empty word is any other letter. ``given`` words are words however rare."""
    runs_schema = pa.schema([("run", pa.string()), ("n", pa.int64())])
    strings_schema = pa.schema([("s", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("n", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(((((run,) for run in _THAI_RUN.findall(said)), 1) for said in _thai_parts(batches)), runs_schema)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(((_strings(run), n) for batch in batches for run, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)), strings_schema)

    distinct = thai.mapInArrow(runs, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    every = distinct.mapInArrow(strings, "s string, head string, tail string, n bigint").groupBy("s", "head", "tail").agg(F.sum("n").alias("n"))
    counted = checkpoint(every.where("n > 1"))
    # Whole letters are the strings whose head is empty.
    letters = counted.where("head = ''").agg(F.sum("n")).first()[0] or 0
    least = max(FEWEST, RAREST * letters)
    near = counted.where(F.col("n") >= 0.5 * least)
    goes_on = near.groupBy(F.col("head").alias("s")).agg(F.max("n").alias("after"))
    follows = near.groupBy(F.col("tail").alias("s")).agg(F.max("n").alias("before"))
    known = near.where((F.col("n") >= least) & (F.length("s") <= LONGEST)).join(goes_on, "s", "left").join(follows, "s", "left")
    free = (F.coalesce("after", F.lit(0)) <= BOUND * F.col("n")) & (F.coalesce("before", F.lit(0)) <= BOUND * F.col("n"))
    found = known.where(free).select("s", "n").toArrow()
    costs = {word: -math.log(n / max(letters, n)) for word, n in zip(*(c.to_pylist() for c in found.columns), strict=True)}
    rare = -math.log(1 / (2 * max(letters, 1)))
    return {"": rare + 1.0} | dict.fromkeys((w for w in given if _THAI_RUN.fullmatch(w)), rare) | costs


def learn_gaps(texts: DataFrame, text: str = "text", given: Iterable[str] = ()) -> Gaps:
    """The dictionary, and openings and endings of Thai sentences, from all Thai texts of a frame.

    A gap that parts sentences has before and after it what ends and begins texts. The share of an
    opening among gaps that its share among beginnings explains is the likelihood that a gap before it
    parts sentences; likewise for endings.
    """
    thai = texts.select(F.col(text).alias("text")).where(F.col("text").rlike("[฀-๿]"))
    words = learn_words(thai, given)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("side", pa.string()), ("entry", pa.string()), ("at_edge", pa.bool_()), ("n", pa.int64())])

    def entries(left: list[str], right: list[str], at_edge: bool) -> Iterator[tuple[str, str, bool]]:
        yield "", "", at_edge
        yield from (("opening", entry, at_edge) for entry in _forms(right))
        yield from (("ending", entry, at_edge) for entry in _forms(left))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[Iterable[tuple], int]]:
            for said in _thai_parts(batches):
                yield entries(_near_gap(said, "", shared.value)[0], _near_gap("", said, shared.value)[1], True), 1
                for gap in _GAP.finditer(said):
                    if gap.start() and gap.end() < len(said):
                        yield entries(*_near_gap(said[: gap.start()], said[gap.end() :], shared.value), False), 1

        yield from _counted(rows(), schema)

    mapped = thai.mapInArrow(work, "side string, entry string, at_edge boolean, n bigint")
    amount = lambda at_edge: F.sum(F.when(F.col("at_edge") == at_edge, F.col("n")).otherwise(0))
    counted = checkpoint(mapped.groupBy("side", "entry").agg(amount(False).alias("n"), amount(True).alias("edge")))
    whole = counted.where("side = ''").first()
    if whole is None or not whole.n:
        return NO_GAPS
    n_texts, n_gaps = whole.edge, whole.n
    # At most 200 openings are that frequent.
    one_word = F.length("entry") - F.length(F.replace("entry", F.lit("|"), F.lit(""))) == 1
    frequent = counted.where((F.col("side") == "opening") & one_word & (F.col("edge") >= n_texts / 200)).collect()
    share = _usual_share(sorted((r.n / n_gaps / (r.edge / n_texts), r.edge) for r in frequent))
    by_first = counted.where((F.col("side") != "") & (F.col("n") >= max(1.0, RAREST * n_gaps))).repartition("side", F.substring_index("entry", "|", 1)).sortWithinPartitions("side", "entry")
    odds_schema = pa.schema([("side", pa.string()), ("entry", pa.string()), ("odds", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from to_batches(_odds(known, share, n_gaps / n_texts), odds_schema)

    found = by_first.select("side", "entry", "n", "edge").mapInArrow(weigh, "side string, entry string, odds double").toArrow()
    odds: dict[str, dict[str, float]] = {"opening": {}, "ending": {}}
    for side, entry, value in zip(*(c.to_pylist() for c in found.columns), strict=True):
        odds[side][entry] = value
    return Gaps(words, odds["opening"], odds["ending"], -math.log(share / (1 - share)))


def _usual_share(ratios: list[tuple[float, int]]) -> float:
    """The share of gaps that part sentences, from how much rarer each frequent opening is at gaps than
    at beginnings; few texts leave it near ``USUAL_SHARE``."""
    total, share, so_far = sum(n for _, n in ratios), USUAL_SHARE, 0
    for ratio, n in ratios:
        so_far += n
        if so_far >= 0.55 * total:
            share = ratio
            break
    share = (share * total + USUAL_SHARE * SHARE_WEIGHT) / (total + SHARE_WEIGHT)
    return min(0.9, max(0.05, share))


def _odds(entries: Iterable[tuple[str, str, int, int]], share: float, gaps_per_text: float) -> Iterator[tuple[str, str, float]]:
    """Side, entry and log odds of the entries, which come by side in the order of their letters, each
    after its shorter forms. Entries with the same odds as their shorter form are left out: the shorter
    one is matched instead."""
    path: list[tuple[str, float, float]] = []
    last = None
    for side, entry, n, edge in entries:
        if side != last:
            path, last = [], side
        while path and not entry.startswith(path[-1][0]):
            path.pop()
        shorter, known = (path[-1][1], path[-1][2]) if path else (share, None)
        explained = min(n, share * gaps_per_text * edge)
        likely = (explained + SMOOTHING * shorter) / (n + SMOOTHING)
        p = min(0.99, max(0.01, likely))
        odds = math.log(p / (1 - p))
        path.append((entry, likely, odds))
        if odds != known:
            yield side, entry, odds


def sentence_units(texts: DataFrame, gaps: Gaps, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, unit_no, first_char and last_char of every unit of every row.

    Null, empty and white texts have no units; repeated rows have theirs each; other columns are
    ignored; an empty table gives no rows.
    """
    types = [texts.schema[k].dataType.simpleString() for k in keys]
    shared = texts.sparkSession.sparkContext.broadcast(gaps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit, first, last = [], [], [], []
            for i, content in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for number, (a, b) in enumerate(sentence_spans(content, shared.value), 1):
                    rows.append(i)
                    unit.append(number)
                    first.append(a)
                    last.append(b)
            place = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in range(len(keys))), pa.array(unit, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=[*keys, "unit_no", "first_char", "last_char"])

    fields = ", ".join(f"`{k}` {t}" for k, t in zip(keys, types, strict=True))
    return texts.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(work, f"{fields}, unit_no bigint, first_char bigint, last_char bigint")
