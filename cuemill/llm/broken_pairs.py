"""Defective pairs of a source text and its translation or rewriting.

Method: the answer walks through a suffix automaton of the source, which measures how much of it is
copied; automata of known and of learned refusal phrases, a stack of delimiters and votes of stopwords
and scripts tell the other defects. One defect per pair, the first that fits of ``DEFECTS``.

Refusals also come in words that no list holds. Phrases are learned from all pairs, labelled by the
known phrases: those that are far more usual in refusals than in other answers. An answer that learned
phrases cover by half, and its source not, is a refusal too; found ones teach more phrases once.

Scale: pairs are judged in the scan's own partitions, and the judgements written with the texts once;
learning reads these. Phrases of refusals are counted by a shuffle, and looked for in other answers
``CANDIDATES`` at a time. Else only pair ids with defects or phrase numbers are shuffled, to count a pair
delivered twice once. How long answers usually are, by kind and languages, is an exact median: ratios are
counted by a shuffle, the different ones of a kind sorted. The learned phrases are sent to all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple
from uuid import uuid4

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuemill.llm.captions import _is_filler, _STARTS, _UNSPACED_FILLER
from cuemill.llm.lexicon import LANGUAGE_NAMES, language_of_label
from cuemill.llm.streams import to_batches
from cuemill.session import scratch

#: Phrases of refusals that are looked for in other answers at a time; more take more turns.
CANDIDATES = 200_000
#: In how many refusals a learned phrase must be, and how much more usual it must be there than elsewhere.
FEWEST, ODDS = 3, 20
#: The share of an answer that learned phrases must cover, and of its source that they may.
COVERED, COVERED_SOURCE = 0.5, 0.3
DEFECTS = ["empty", "refusal", "copy", "wrong_language", "truncated"]

# What stands for an answer that is none, in lower case.
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "nan", "no output", "no answer", "no translation", "empty", "todo", "tbd", "undefined", "not available", "无", "暂无", "空", "なし", "该内容为空"}
# Words of a heading before an answer, in lower case.
HEADINGS = ["translation", "translated text", "translated", "rewritten", "rewritten text", "rewrite", "output", "answer", "result", "text", "译文", "翻译", "改写", "翻訳", "訳文", "übersetzung", "traduction", "traducción", "перевод", "ترجمة", "अनुवाद", "คำแปล"]
# Phrases that decline a task; two points make a refusal.
REFUSALS = {
    2: [
        "help with that", "help with this", "assist with", "as an assistant", "as an ai", "i must decline", "have to decline", "unable to process", "unable to", "not permitted to", "not allowed to", "won't be able to",
        "will not be able to", "leave this one", "rather not", "isn't something i can", "is not something i can", "beyond what i", "cannot be handled", "can't be handled", "can't produce", "cannot produce", "can't translate",
        "cannot translate", "can't rewrite", "cannot rewrite", "can't process", "cannot process", "can't complete", "cannot complete", "cannot fulfill", "can't fulfill", "against my guidelines", "can't provide", "cannot provide", "answer can be given", "version can be given", "given for this", "no answer can", "not able to help",
        "als assistent", "ablehnen", "nicht helfen", "nicht behilflich", "außerhalb meiner möglichkeiten", "nicht bearbeiten", "nicht verarbeiten", "nicht erlaubt", "nicht übersetzen", "nicht umschreiben", "nicht möglich, diese", "lieber nicht", "keine fassung", "keine antwort geben", "keine version", "übersteigt meine",
        "en tant qu'assistant", "je dois refuser", "traiter cette demande", "pas autorisé", "pas en mesure", "traiter ce passage", "traiter ce contenu", "vous aider", "je préfère ne pas", "hors de ma portée", "aucune version", "aucune réponse ne peut", "dépasse ce que", "donner suite",
        "como asistente", "debo rechazar", "no tengo permitido", "prefiero no", "procesar este", "procesar esta", "tratar este", "ayudar con", "ayudarle con", "fuera de mis posibilidades", "fuera de mi alcance", "no me es posible", "no puedo ayudar", "esta solicitud", "esta petición", "no se puede ofrecer", "supera lo que puedo", "no puedo ofrecer",
        "как ассистент", "помочь с", "этим запросом", "обработать этот", "обработать это", "не могу выполнить", "вынужден отказать", "должен отказать", "отказаться", "не имею права", "мне не разрешено", "за пределами моих возможностей", "лучше не буду", "не в состоянии", "ответ дать нельзя", "не могу дать", "не могу обработать", "не могу перевести", "невозможно предоставить",
        "无法协助", "不能处理", "无法处理", "无法完成", "没有办法给出", "无法提供", "不能作答", "不被允许", "只能拒绝", "超出了我的", "不符合使用要求", "作为一个助手", "作为助手", "我不能翻译", "我无法翻译", "无法改写", "无法帮助", "不便处理", "选择不", "恕难",
        "アシスタントとして", "お手伝いすることはでき", "対応できません", "対応できかね", "処理できかね", "処理できません", "お応えでき", "お断り", "翻訳できません", "応じられません", "控えさせて", "許可されていません", "私の範囲を超え", "お受けでき",
        "لا أستطيع معالجة", "لا يمكنني معالجة", "المساعدة في هذا", "مساعدتك", "بصفتي مساعد", "أن أرفض", "غير مسموح لي", "لا يمكنني ترجمة", "لا أستطيع ترجمة", "خارج نطاق", "أفضل عدم", "معالجة هذا الطلب",
        "सहायता नहीं कर", "मदद नहीं कर", "संसाधित नहीं", "सहायक के रूप में", "अस्वीकार", "मना करना", "अनुमति नहीं", "इस अनुरोध", "अनुवाद नहीं कर", "मेरी सीमा से बाहर", "असमर्थ हूँ", "असमर्थ हूं", "संभव नहीं है",
        "ช่วยเหลือคำขอ", "ไม่สามารถช่วย", "ไม่สามารถประมวลผล", "ในฐานะผู้ช่วย", "ต้องปฏิเสธ", "ขอปฏิเสธ", "ไม่ได้รับอนุญาต", "ไม่สามารถแปล", "เกินขอบเขต", "ไม่สามารถดำเนินการ",
    ],
    1: [
        "i'm sorry", "i am sorry", "i apologize", "i apologise", "unfortunately", "i'm afraid", "i am afraid", "thanks for the text", "thank you for", "this request", "that request", "this passage", "this text", "this content", "the material", "its content", "sensitive", "anything else", "something else you need",
        "more context", "different paragraph", "this paragraph", "another one", "contenu est sensible", "contenido es delicado", "inhalt heikel", "merci d'envoyer", "envíe otro", "bitte senden sie", "пришлите другой", "try again", "guidelines", "policy", "leider", "bedaure", "diese anfrage", "diesen text", "diesen inhalt", "diese aufgabe", "die aufgabe", "anderen text", "malheureusement", "désolé", "cette demande", "ce texte", "ce contenu", "un autre texte",
        "lamentablemente", "lo siento", "este texto", "este pasaje", "este contenido", "otro texto", "к сожалению", "этот текст", "этот запрос", "другой текст", "这个请求", "本次请求", "这段内容", "此内容", "这段文字", "内容可能敏感", "其他段落", "换一段", "换个问题", "感谢您的输入", "このご依頼", "この内容", "このリクエスト",
        "别的内容", "عذرا", "أعتذر", "هذا الطلب", "هذا المحتوى", "هذا النص", "نص آخر", "क्षमा करें", "यह सामग्री", "इस पाठ", "ขออภัย", "คำขอนี้", "เนื้อหานี้", "ข้อความนี้",
    ],
}
# What marks an unfinished text at its end, in lower case.
UNFINISHED = ("[continued]", "(continued)", "[...]", "[…]", "[to be continued]", "(to be continued)", "[truncated]", "(truncated)", "[cut]", "to be continued", "continued", "（未完）", "（待续）", "[待续]", "（続く）", "(suite)", "[fortsetzung folgt]")

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HTTP = re.compile(r"https?[:/]+[!-~]+")
_JOINED = re.compile(r"[./_\\:][A-Za-z0-9-]")
_JOINED_OR_NUMBER = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(?:[./_\\:][A-Za-z0-9-]++)+|[0-9]+(?:[.,:][0-9]+)*")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[0-9]+(?:[.,:][0-9]+)*")
_TWO_LETTERS = regex.compile(r"\p{L}\P{L}*\p{L}")
_LETTER = regex.compile(r"\p{L}")
_OUTSIDE = "*_`~\"'“”„«»「」#—–-"
_ASIDE_AT_END = regex.compile(r"\s[(（][\p{L}\p{M}\s'-]{1,30}[)）]$")
_LANGUAGE_HEADING = "|".join(sorted((regex.escape(n) for names in LANGUAGE_NAMES.values() for n in names if len(n) > 2 or n >= "⺀"), key=len, reverse=True))
_HEADING = regex.compile(rf"^(?:#+\s*)?(?:here (?:is|are)[^:：\n]{{0,60}}|{_LANGUAGE_HEADING}|{'|'.join(map(regex.escape, HEADINGS))})(?:\s*\((?:uk|us)\))?\s*(?:[:：]|\n)\s*", regex.I)
#: How headings start; only texts that start so are looked at.
_HEADING_STARTS = frozenset(n[:2].casefold() for n in [*HEADINGS, "here", *(n for names in LANGUAGE_NAMES.values() for n in names if len(n) > 2 or n >= "⺀")])
_STOPS = ".!?…。！？؟।۔"
_CLOSERS = "\"'”’“»」』)）]】›"
_MARKS = ",，、،;；:："
_SENTENCE = re.compile(r"(?<=[.!?…؟।۔])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*|\n+")
#: Stops that end a sentence; an abbreviation, marked by a zero character, counts as white space behind them.
_COUNTED = re.compile(r"[.!?؟।۔](?=[\s\"'”’»)\]]|$|[^\W\d_]{1,2}\x00)|[。！？]|…+|\.{3,}")
_IN_BRACKETS = re.compile(r"[(（][^()（）]*[)）]")
#: Stops of abbreviations and initials.
_SHORT_STOP = regex.compile(r"(?<=\b\p{L}{1,2})\.")
# Scripts that tell a language, with a letter for each.
_SCRIPTS = {"j": ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), "z": ("zh", regex.compile(r"\p{Han}")), "t": ("th", regex.compile(r"\p{Thai}")), "a": ("ar", regex.compile(r"\p{Arabic}")), "h": ("hi", regex.compile(r"\p{Devanagari}")), "r": ("ru", regex.compile(r"\p{Cyrillic}")), "l": ("", regex.compile(r"\p{Latin}"))}
# Letters that point to one of the languages in Latin script.
_LETTERS_OF = {"de": "ßäöü", "es": "ñ¿¡íóú", "fr": "çœèêëîôûàù"}
_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‘": "’"}
_DELIMITERS = re.compile("[" + re.escape("".join({*_OPEN, *_OPEN.values()})) + "]")


class _Table(dict):
    """A table for ``str.translate`` that is made by a rule, character by character as they come."""

    def __init__(self, rule: Callable[[str], str | None]):
        self._rule = rule

    def __missing__(self, code: int) -> str | None:
        self[code] = self._rule(chr(code))
        return self[code]


def _is_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN"


_KEPT = _Table(lambda c: c if _is_word(c) else None)
_SPACED = _Table(lambda c: c if _is_word(c) else " ")
#: The script of each character as a letter.
_SCRIPT_OF = _Table(lambda c: next((letter for letter, (_, pattern) in _SCRIPTS.items() if pattern.match(c)), " "))
_BARE = _Table(lambda c: c if c in _OUTSIDE or (unicodedata.category(c)[0] in "ZC" or c.isspace()) else "x")


_NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)


def words_of(text: str) -> list[str]:
    """The runs of letters, marks and digits of a text."""
    return text.translate(_SPACED).split()


@lru_cache(maxsize=8)
def without_addresses(text: str) -> str:
    """A text with a space for each address, file name and number."""
    if "http" in text:
        text = _HTTP.sub(" ", text)
    if _JOINED.search(text):
        return _JOINED_OR_NUMBER.sub(" ", text)
    return _NUMBERS.sub(" ", text) if _DIGIT.search(text) else text


class SuffixAutomaton:
    """The automaton of all substrings of a text, built letter by letter."""

    def __init__(self, text: str):
        self._next: list[dict[str, int]] = [{}]
        self._link = [-1]
        self._length = [0]
        last = 0
        for letter in text:
            state = len(self._next)
            self._next.append({})
            self._length.append(self._length[last] + 1)
            self._link.append(0)
            p = last
            while p >= 0 and letter not in self._next[p]:
                self._next[p][letter] = state
                p = self._link[p]
            if p >= 0:
                q = self._next[p][letter]
                if self._length[p] + 1 == self._length[q]:
                    self._link[state] = q
                else:
                    clone = len(self._next)
                    self._next.append(dict(self._next[q]))
                    self._length.append(self._length[p] + 1)
                    self._link.append(self._link[q])
                    while p >= 0 and self._next[p].get(letter) == q:
                        self._next[p][letter] = clone
                        p = self._link[p]
                    self._link[q] = self._link[state] = clone
            last = state

    def copied(self, text: str, least: int) -> int:
        """How many letters of ``text`` lie in substrings of at least ``least`` letters of the source."""
        state = length = covered = until = 0
        for i, letter in enumerate(text):
            while state and letter not in self._next[state]:
                state = self._link[state]
                length = self._length[state]
            if letter in self._next[state]:
                state = self._next[state][letter]
                length += 1
            else:
                length = 0
            if length >= least:
                begin = max(i + 1 - length, until)
                covered += i + 1 - begin
                until = i + 1
        return covered


def _least(answer: str, least: int | None) -> int:
    return min(least or (6 if max(answer) >= "⺀" and sum(c >= "⺀" for c in answer) > len(answer) / 2 else 12), len(answer))


def copied_share(source: str, answer: str, least: int | None = None) -> float:
    """The share of the answer that is copied from the source, both as keys. Matches count from ``least``
    letters on, else from 12 (6 in scripts without spaces), or the whole answer if that is shorter."""
    if not answer or not source:
        return 0.0
    return 1.0 if answer in source else SuffixAutomaton(source).copied(answer, _least(answer, least)) / len(answer)


def is_copied(source: str, answer: str, share: float, least: int | None = None) -> bool:
    """Whether ``copied_share`` is at least ``share``, which must be above 0.

    Two tests before the automaton only tell texts that have too little in common for that. A common
    substring of the least length or longer holds whole blocks of half that length, one for every
    3 * half - 2 letters at least; and every copied letter lies in a common substring of the least length.
    """
    if not answer or not source:
        return False
    if answer in source:
        return True
    least = _least(answer, least)
    half = least // 2
    if half and sum(answer[i : i + half] in source for i in range(0, len(answer) - half + 1, half)) * (3 * half - 2) < share * len(answer):
        return False
    known = {source[i : i + least] for i in range(len(source) - least + 1)}
    common = sum(answer[i : i + least] in known for i in range(len(answer) - least + 1))
    return common * least >= share * len(answer) and copied_share(source, answer, least) >= share


@lru_cache(maxsize=8)
def key_of(text: str) -> str:
    """Letters and digits in lower case."""
    return text.casefold().translate(_KEPT)


def _stripped(text: str) -> str:
    """A text without white space, controls and decoration around it, and without signs at its end."""
    begin, end = 0, len(text)
    while begin < end and (text[begin] == ">" or _BARE[ord(text[begin])] != "x"):
        begin += 1
    while begin < end and (_BARE[ord(text[end - 1])] != "x" or unicodedata.category(text[end - 1]) == "So"):
        end -= 1
    return text[begin:end]


@lru_cache(maxsize=8)
def unwrapped(answer: str) -> str:
    """An answer without tags, fences, quotation marks around it and headings before it."""
    text = _TAG.sub("", answer) if "<" in answer else answer
    for _ in range(3):
        before = text
        text = _stripped(text)
        if text[:2].casefold() in _HEADING_STARTS:
            text = _HEADING.sub("", text + "\n").rstrip("\n") if _HEADING.match(text + "\n") else text
        if text == before:
            break
    return text


def is_empty(answer: str | None, source: str) -> bool:
    """No answer text, or only a placeholder or wrapper. An answer like its source is none."""
    if answer is None:
        return True
    plain = unwrapped(answer)
    key = key_of(plain)
    return not key or (key != key_of(source) and _is_placeholder(plain))


def _is_placeholder(plain: str) -> bool:
    return plain.strip().lstrip("[({<").rstrip("])}>.").strip().casefold() in PLACEHOLDERS


def words_left(source: str) -> bool:
    """Whether a source has anything to translate: words beside addresses, file names and numbers."""
    return _TWO_LETTERS.search(without_addresses(source)) is not None


def _refusal_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for points, phrases in REFUSALS.items():
        for phrase in phrases:
            automaton.add_word(phrase.casefold(), (points, phrase))
    automaton.make_automaton()
    return automaton


_AUTOMATA: list = []


def _refusal_phrases(plain: str) -> list[tuple[int, int, int, str]]:
    """Where refusal phrases begin and end in a squeezed text in small letters, and their points."""
    if not _AUTOMATA:
        _AUTOMATA.append(_refusal_automaton())
    return [(last + 1 - len(phrase.casefold()), last + 1, points, phrase) for last, (points, phrase) in _AUTOMATA[0].iter(plain)]


@lru_cache(maxsize=8)
def _squeezed(text: str) -> str:
    return " ".join(text.replace("’", "'").casefold().split())


def _points(phrases: list[tuple[int, int, int, str]]) -> int:
    found = {phrase: points for _, _, points, phrase in phrases}
    return sum(found.values()) if max(found.values(), default=0) == 2 else 2 * (len(found) >= 3)


def refusal_points(text: str) -> int:
    """Points of different refusal phrases in a text: if none is worth two, three of them count two."""
    return _points(_refusal_phrases(_squeezed(text)))


def _declining(plain: str, phrases: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a text that refusal phrases speak for: their sentences, but of a long sentence or a
    text without stops only what is near the phrase. In order and apart."""
    edges = [0, *(m.end() for m in _SENTENCE.finditer(plain)), len(plain)]
    parts: list[tuple[int, int]] = []
    for begin, end, _, phrase in sorted(phrases):
        near = 25 if phrase[0] >= "⺀" else 60
        first = max(edges[bisect_right(edges, begin) - 1], begin - near)
        last = min(edges[min(bisect_left(edges, end), len(edges) - 1)], end + near)
        if parts and first <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(last, parts[-1][1]))
        else:
            parts.append((first, last))
    return parts


def _grams(text: str) -> set[str]:
    """Phrases of a squeezed text: two to four words, or four, six and eight letters of scripts without spaces."""
    if 2 * sum(map("฀".__le__, text)) > len(text):
        return {text[i : i + k] for k in (4, 6, 8) for i in range(len(text) - k + 1)}
    words = [m.span() for m in _PHRASE_WORD.finditer(text)]
    return {text[words[i][0] : words[i + k - 1][1]] for k in (2, 3, 4) for i in range(len(words) - k + 1)}


_PHRASE_WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")


def automaton_of(phrases: Iterable[str]):
    """An automaton of phrases, or None of none."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def covered(text: str, automaton) -> float:
    """The share of a squeezed text that an automaton's phrases cover."""
    return _share(automaton.iter(text), text)


def _share(found: Iterable[tuple[int, int]], text: str) -> float:
    """The share of a text that phrases found at (last letter, length) cover."""
    total = until = 0
    for begin, end in sorted((last + 1 - length, last + 1) for last, length in found):
        total += max(0, end - max(begin, until))
        until = max(until, end)
    return total / max(1, len(text))


def learn_refusals(pairs: list[tuple[str | None, str | None]], rounds: int = 2) -> list[str]:
    """Phrases of refusals out of (source, answer) of pairs, labelled by the known phrases first and by
    what was learned then. ``learn_from`` does the same over a table."""
    texts = [(_squeezed(source or ""), _squeezed(unwrapped(answer))) for source, answer in pairs if answer]
    declines = [is_refusal(answer, source) for source, answer in texts]
    phrases: list[str] = []
    for _ in range(rounds):
        inside = Counter(g for (_, answer), no in zip(texts, declines, strict=True) if no for g in _grams(answer))
        known = automaton_of(g for g, n in inside.items() if n >= FEWEST)
        if known is None:
            return phrases
        outside = Counter(g for (_, answer), no in zip(texts, declines, strict=True) if not no for g in {answer[last + 1 - n : last + 1] for last, n in known.iter(answer)})
        refused = sum(declines)
        rare = ODDS * refused / max(1, len(texts) - refused)
        phrases = sorted(g for g, n in inside.items() if n >= FEWEST and n >= rare * (outside[g] + 0.5))
        learned = automaton_of(phrases)
        declines = [no or _told_by(answer, source, learned) for (source, answer), no in zip(texts, declines, strict=True)]
    return phrases


def _saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SENT: list = [None, None]


def _sent(phrases) -> object:
    """The automaton of a broadcast (mark, phrases), built once a worker."""
    mark, words = phrases.value
    if _SENT[0] != mark:
        _SENT[:] = mark, automaton_of(words)
    return _SENT[1]


def _needed(phrases: list[str]) -> list[str]:
    """Phrases without those that shorter ones of them cover wholly wherever they stand; what the others
    cover of any text is the same."""
    every = automaton_of(phrases)
    out = []
    for phrase in phrases:
        until = 0
        for begin, end in sorted((last + 1 - length, last + 1) for last, length in every.iter(phrase) if length < len(phrase)):
            if begin > until:
                break
            until = max(until, end)
        if until < len(phrase):
            out.append(phrase)
    return out


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """op, pair_id and phrase of each phrase in answers."""
    schema = pa.schema([(n, pa.string()) for n in ("op", "pair_id", "phrase")])
    rows = ((op, pair_id, gram) for batch in batches for op, pair_id, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True) for gram in _grams(plain))
    yield from to_batches(rows, schema)


def _look(texts: DataFrame, phrases: list[str], before, turns: int) -> DataFrame:
    """op, pair_id, no (a refusal by known phrases or by those of ``before``) and hits of each answer: the numbers
    of the phrases in it, if it is none. With plain, source and open of answers that phrases of ``turns``
    such looks may cover enough."""
    sent = texts.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("op", pa.string()), ("pair_id", pa.string()), ("no", pa.bool_()), ("hits", pa.list_(pa.int32())), ("plain", pa.string()), ("source", pa.string()), ("open", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers_of = {phrase: i for i, phrase in enumerate(sent.value)}
        known = automaton_of(sent.value)

        def rows() -> Iterator[tuple]:
            learned = _sent(before) if before else None
            for batch in batches:
                for op, pair_id, refused, plain, source, may_be in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [] if refused else list(known.iter(plain))
                    no = refused or _told_by(plain, source, learned)
                    hits = [] if no else list({numbers_of[plain[last + 1 - n : last + 1]] for last, n in found})
                    yield op, pair_id, no, hits, *((plain, source, may_be) if found and turns * _share(found, plain) >= COVERED - 1e-9 else (None, None, None))

        yield from to_batches(rows(), schema)

    rows = texts.select("op", "pair_id", "refused", "plain", F.coalesce("source", F.lit("")), "open")
    return _saved(rows.mapInArrow(work, "op string, pair_id string, no boolean, hits array<int>, plain string, source string, open boolean"), "looked")


def _telling(looked: DataFrame, candidates: list[tuple[str, int]]) -> list[str]:
    """Those of candidates, with the number of refusals they are in, that are far more usual in refusals
    than elsewhere."""
    pairs = looked.groupBy("op", "pair_id").agg(F.max("no").alias("no"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    # -1 counts the other answers, -2 the refusals.
    ids = F.when(F.col("no"), F.array(F.lit(-2))).otherwise(F.concat("hits", F.array(F.lit(-1))))
    outside = {r.id: r["count"] for r in pairs.select(F.explode(ids).alias("id")).groupBy("id").count().collect()}
    rare = ODDS * outside.get(-2, 0) / max(1, outside.get(-1, 0))
    return [phrase for i, (phrase, n) in enumerate(candidates) if n >= rare * (outside.get(i, 0) + 0.5)]


def _told(texts: DataFrame, phrases) -> DataFrame:
    """The answers that learned phrases tell to be refusals."""
    schema = pa.schema([("op", pa.string()), ("pair_id", pa.string()), ("plain", pa.string()), ("source", pa.string()), ("open", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            learned = _sent(phrases)
            for batch in batches:
                yield from (row for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _told_by(row[2], row[3], learned))

        yield from to_batches(rows(), schema)

    return _saved(texts.mapInArrow(work, "op string, pair_id string, plain string, source string, open boolean"), "told")


def learn_from(texts: DataFrame, rounds: int = 2) -> tuple[list[str], DataFrame | None]:
    """The phrases that ``learn_refusals`` learns, out of all rows of a table, without those that others
    cover, and the answers that only they tell to be refusals (none of no phrases).

    ``texts`` has op, pair_id, source, plain (the squeezed answer, never null), refused (by the known phrases)
    and open (whether learned phrases may decide). A pair delivered twice counts once.
    """
    phrases: list[str] = []
    refusals = texts.where("refused").select("op", "pair_id", "plain")
    told = before = None
    for _ in range(rounds):
        declined = refusals if told is None else refusals.unionByName(told.select("op", "pair_id", "plain"))
        counted = declined.mapInArrow(_grams_of, "op string, pair_id string, phrase string").distinct().groupBy("phrase").count().where(F.col("count") >= FEWEST)
        inside = _saved(counted, "phrases")
        turns = -(-inside.count() // CANDIDATES)
        phrases, looks = [], []
        for turn in range(turns):
            candidates = [tuple(r) for r in inside.where(F.pmod(F.xxhash64("phrase"), F.lit(turns)) == turn).collect()]
            if not candidates:
                continue
            looks.append(_look(texts, [phrase for phrase, _ in candidates], before, turns))
            phrases += _telling(looks[-1], candidates)
        if not phrases:
            return [], None
        phrases = sorted(_needed(phrases))
        before = texts.sparkSession.sparkContext.broadcast((uuid4().hex, phrases))
        covered_ones = reduce(DataFrame.unionByName, looks).where("plain is not null").select("op", "pair_id", "plain", "source", "open")
        told = _told(covered_ones if turns == 1 else covered_ones.distinct(), before)
        if told.isEmpty():  # nothing that would change in another round
            break
    return phrases, told


def _told_by(answer: str, source: str, learned) -> bool:
    """Whether learned phrases cover an answer, squeezed already, and not its source."""
    return learned is not None and covered(answer, learned) >= COVERED and covered(_squeezed(source), learned) < COVERED_SOURCE


def is_refusal(answer: str, source: str, learned=None) -> bool:
    """Declines the task: a text with refusal phrases that its source doesn't have, or one that learned
    phrases cover (``learned`` is an automaton of these).

    The phrases must speak for a third of the text, whatever its length; or there are several, they
    open the text, and the rest isn't the source's content: little of it copied, and not its numbers.
    A refusal quoted within a real answer does neither.
    """
    plain = _squeezed(answer)
    phrases = _refusal_phrases(plain)
    points = _points(phrases)
    if learned is not None and _told_by(plain, source, learned):
        return True
    if points < 2 or refusal_points(source) >= 2:
        return False
    parts = _declining(plain, phrases)
    if 3 * sum(b - a for a, b in parts) >= len(plain):
        return True
    if points < 5 or 4 * min(begin for begin, _, worth, _ in phrases if worth == max(p[2] for p in phrases)) > len(plain):
        return False
    rest = "".join(plain[a:b] for a, b in zip([0, *(b for _, b in parts)], [*(a for a, _ in parts), len(plain)], strict=True))
    wanted, got = Counter(numbers(source)), Counter(numbers(rest))
    return not is_copied(key_of(source), key_of(rest), 0.5) and 2 * (wanted & got).total() <= wanted.total()


def language_votes(text: str, stopwords: dict[str, list[str]]) -> Counter:
    """Letters of a text by language: scripts for most, stopwords and letters for Latin ones; letters
    whose language is open count for '?'."""
    return _votes(without_addresses(text), stopwords)


def _votes(plain: str, stopwords: dict[str, list[str]]) -> Counter:
    votes: Counter = Counter()
    ascii_only = plain.isascii()
    scripts = "" if ascii_only else plain.translate(_SCRIPT_OF)
    present = [] if ascii_only else [letter for letter in _SCRIPTS if letter in scripts and letter != "l"]
    if present and "l" not in scripts and len({"j" if "j" in present and letter == "z" else letter for letter in present}) == 1:
        # One language's script only: what its parts add up to is known.
        votes[_SCRIPTS[present[0]][0]] = sum(map(scripts.count, present)) * (2 if present[0] in "jz" else 1)
        return votes
    whole: Counter = Counter()
    open_letters = begin = 0
    for cut in [*_SENTENCE.finditer(plain), None]:
        end = cut.start() if cut else len(plain)
        kinds = scripts[begin:end]
        segment, begin = plain[begin:end], cut.end() if cut else end
        latin = len(segment.encode().translate(None, _NO_LETTERS)) if ascii_only else kinds.count("l")
        if present and not segment.isascii():
            counts = {letter: kinds.count(letter) for letter in present}
            if "j" in counts:
                counts["j"] += counts.pop("z", 0)
            letter = max(counts, key=counts.__getitem__)
            most = counts[letter]
            if most and most * (3 if letter in "jz" else 1.2) >= latin:
                votes[_SCRIPTS[letter][0]] += most * (2 if letter in "jz" else 1)
                continue
        if not latin:
            continue
        found: dict[str, float] = {}
        lower = segment.lower()
        for lang in chain.from_iterable(filter(None, map(stopwords.get, lower.translate(_SPACED).split()))):
            found[lang] = found.get(lang, 0) + 1
        if not segment.isascii():
            for lang, letters in _LETTERS_OF.items():
                found[lang] = found.get(lang, 0) + 0.7 * sum(map(lower.count, letters))
        for lang, n in found.items():
            whole[lang] += n
        best = sorted(found.values(), reverse=True)
        if best and best[0] > 0 and (len(best) == 1 or best[0] > best[1]):
            votes[max(found, key=found.__getitem__)] += latin
        else:
            open_letters += latin
    if open_letters:
        best = whole.most_common(1)
        votes[best[0][0] if best and best[0][1] > 0 else "?"] += open_letters
    return votes


def main_language(votes: Counter) -> str | None:
    """The language with most letters, if any is known."""
    known = [(n, code) for code, n in votes.items() if code != "?"]
    return max(known)[1] if known else None


_known_filler = lru_cache(maxsize=1 << 16)(_is_filler)


def fillers_in(text: str) -> int:
    """How many hesitation sounds a text has."""
    n = 0
    for word in words_of(text.casefold()):
        if word[0] in _STARTS and _known_filler(word):
            n += 1
        elif word[0] >= "⺀":
            n += len(_UNSPACED_FILLER.findall(word))
    return n


def _doubled(text: str) -> int:
    """How many words are said twice in a row."""
    words = words_of(text.casefold())
    return sum(a == b for a, b in zip(words, words[1:], strict=False))


def is_mended(source: str, answer: str) -> bool:
    """Whether an answer does to speech without fillers what a rewriting should: it adds stops that are
    missing, or any marks if there are none, or leaves out a word said twice. A stop at the very end
    counts if the text starts like a sentence too. Numbers and addresses have no marks."""
    if _doubled(answer) < _doubled(source):
        return True
    before, after = (without_addresses(t).strip() for t in (source, answer))
    inner = after.rstrip(_STOPS + _CLOSERS + " ")
    stops, told = (sum(map(t.count, _STOPS)) for t in (before, inner))
    if told > stops or (not stops and not sum(map(before.count, _MARKS)) and sum(map(inner.count, _MARKS))):
        return True
    if stops or inner == after or answer.isupper():
        return False
    first, start = (_LETTER.search(t) for t in (source, answer))
    return first is not None and start is not None and not start.group().islower() and not first.group().isupper()


def is_copy(op: str, source: str, answer: str, source_language: str | None, target: str | None) -> bool:
    """Repeats its source. A rewriting shares most words with its source by nature: it is a copy if it
    keeps the fillers too, or, of a source without any, if it mends nothing. A source without words
    has nothing to translate or rewrite; one with words that needs no mending is still repeated."""
    if op == "translate":
        if (target is not None and source_language == target) or not words_left(source):
            return False
        return is_copied(key_of(without_addresses(source)), key_of(without_addresses(answer)), 0.85)
    source_key, answer_key = key_of(source), key_of(answer)
    had, has = fillers_in(source), fillers_in(answer)
    if had:
        if has < max(1, 0.8 * had):
            return False
        return source_key == answer_key or (min(len(source_key), len(answer_key)) > 0.5 * len(source_key) and is_copied(source_key, answer_key, 0.9))
    if not words_left(source) or is_mended(source, answer):
        return False
    if source_key == answer_key:
        return True
    # A slip parts a short text into matches of less than the usual length, and weighs more.
    least, share = (max(3, len(answer_key) // 5), 0.85) if len(answer_key) < 60 else (None, 0.9)
    return len(answer_key) >= 0.75 * len(source_key) and is_copied(source_key, answer_key, share, least)


def _open_delimiters(text: str) -> int:
    """Delimiters left open at the end, by a stack."""
    stack: list[str] = []
    for c in _DELIMITERS.findall(text):
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
    return len(stack)


_DECORATION = frozenset(["Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn", "So"])
_LONGEST_MARK = 2 * max(map(len, UNFINISHED))


class Ending(NamedTuple):
    """How a text ends: with a stop, with dots, with an open delimiter or mark of something missing."""

    stop: bool
    dots: bool
    open: bool
    marked: bool


def _without_decoration(text: str) -> str:
    end = len(text)
    while end and (text[end - 1] in "*_`~—–-" or text[end - 1].isspace() or unicodedata.category(text[end - 1]) in _DECORATION):
        end -= 1
    return text[:end]


def ending(text: str) -> Ending:
    """The ending of a text without decoration behind it."""
    plain = text.strip()
    marked = plain[-_LONGEST_MARK:].casefold().endswith(UNFINISHED)
    aside = _ASIDE_AT_END.search(plain, max(0, len(plain) - 33)) if plain.endswith((")", "）")) else None
    plain = _without_decoration(plain[: aside.start()] if aside else plain)
    bare = plain.rstrip(_CLOSERS + " ")
    dots = bare.endswith(("...", "…", "……", ".."))
    return Ending(bare[-1:] in _STOPS and bare != "", dots, _open_delimiters(plain) > 0, marked)


def sentences(text: str) -> int:
    """A rough count of sentences that end in a stop."""
    if "(" in text or "（" in text:
        text = _IN_BRACKETS.sub(" ", text)
    return len(_COUNTED.findall(_SHORT_STOP.sub("\0", text) if "." in text else text))


_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")


def numbers(text: str) -> list[str]:
    """The digits of each number, in order."""
    return [n.replace(".", "").replace(",", "") for n in _NUMBER.findall(text)]


def tail_missing(source: str, answer: str) -> bool:
    """Whether the numbers at the end of the source are missing at the end of the answer, while those
    before are there."""
    wanted, got = numbers(source), Counter(numbers(answer))
    if len(wanted) < 2:
        return False
    have = []
    for n in wanted:
        have.append(got[n] > 0)
        got[n] -= 1
    last = max((i for i, ok in enumerate(have) if ok), default=-1)
    return last >= 0 and last < len(wanted) - 1 and sum(have[: last + 1]) >= 0.9 * (last + 1)


class Judgement(NamedTuple):
    """What a pair shows by itself: its defect unless it may only be truncated, and for that the
    languages, the answer's length over the source's, and signs; ``usual`` tells whether its length
    counts for what is usual."""

    defect: str | None
    language: str = "?"
    target: str = "?"
    ratio: float = 1.0
    long: bool = False
    marked: bool = False
    fewer: bool = False
    unfinished: bool = False
    usual: bool = False


def judge_alone(op: str, source: str | None, answer: str | None, label: str | None, stopwords: dict[str, list[str]], learned=None) -> Judgement:
    """The judgement of a pair without knowing how long answers usually are."""
    source = source or ""
    if answer is None:
        return Judgement("empty")
    plain = unwrapped(answer)
    source_key, key = key_of(source), key_of(plain)
    if not key:
        return Judgement("empty" if source_key else None)
    if key != source_key and _is_placeholder(plain):
        return Judgement("empty")
    if is_refusal(plain, source, learned):
        return Judgement("refusal")
    if key == source_key and not words_left(source):
        return Judgement(None)
    target = language_of_label(label)
    language = main_language(language_votes(source, stopwords))
    if is_copy(op, source, plain, language, target):
        return Judgement("copy")
    votes = language_votes(plain, stopwords)
    if target in LANGUAGE_NAMES and words_left(plain):
        known = sum(n for code, n in votes.items() if code != "?")
        if known and known - votes[target] > 0.5 * sum(votes.values()):
            return Judgement("wrong_language")
    answer = _TAG.sub("", answer) if "<" in answer else answer
    ours, theirs = ending(answer), ending(source)
    said, told = sentences(source), sentences(answer)
    cut = target != "th" and not ours.stop and (theirs.stop or said == 0)
    return Judgement(
        None,
        language or "?",
        target or "?",
        len(answer.strip()) / max(1, len(source.strip())),
        len(source) > 60,
        ours.marked and not theirs.marked,
        said > 0 and target != "th" and told <= 0.75 * said,
        cut or (ours.open and not theirs.open) or (ours.dots and not theirs.dots) or tail_missing(source, answer),
        len(source) >= 40 and (ours.stop or target == "th") and main_language(votes) == target and not (op == "translate" and language == target),
    )


def is_truncated(found: Judgement, usual: float) -> bool:
    """Ends before the source's content is covered.

    ``usual`` is how long answers of these languages usually are, as a multiple of the source. An
    answer far below that is truncated; one that is somewhat shorter must also have far fewer
    sentences, end unfinished or have lost the source's last numbers. An answer may end where its
    source does.
    """
    size = found.ratio / max(usual, 1e-9)
    return found.marked or (found.long and size < 0.5) or (size < 0.82 and (found.unfinished or (size < 0.66 and found.long and found.fewer)))


def judge(op: str, source: str | None, answer: str | None, label: str | None, stopwords: dict[str, list[str]], usual: dict[tuple[str, str, str], float]) -> str | None:
    """The first defect of a pair, or None."""
    found = judge_alone(op, source, answer, label, stopwords)
    if found.defect:
        return found.defect
    return "truncated" if is_truncated(found, usual.get((op, found.language, found.target), 1.0)) else None


def stopwords_of(common_words: DataFrame) -> dict[str, list[str]]:
    """The languages in Latin script by stopword; the table is a short list, more rows are an error."""
    rows = common_words.where("lang is not null and word is not null").select("lang", "word").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is meant to be a short list")
    out: dict[str, list[str]] = {}
    for lang, word in sorted(rows):
        code = language_of_label(lang)
        if code in ("en", "de", "fr", "es"):
            out.setdefault(word.lower(), []).append(code)
    return out


_PAIR_COLUMNS = ["op", "pair_id", "source", "answer", "label"]


def pairs_of(translations: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Translations and rewritings as op, pair_id, source, answer, label."""
    return translations.select(F.lit("translate").alias("op"), "pair_id", F.col("english_text").alias("source"), F.col("translated_text").alias("answer"), F.col("translate_language").alias("label")).unionByName(
        rewrites.select(F.lit("rewrite").alias("op"), "pair_id", F.col("text").alias("source"), F.col("rewritten").alias("answer"), F.col("rewrite_lang").alias("label"))
    )


def broken_pairs(pairs: DataFrame, common_words: DataFrame) -> DataFrame:
    """op, pair_id and defect of each defective pair, once.

    ``pairs`` has op (translate or rewrite), pair_id, source, answer, label (the language asked for).
    Null and blank answers are empty, unless the source is blank too; with a null source the answer
    is judged alone; a label that names none of the ten languages sets no language. Other columns are
    ignored; an empty table gives no rows.
    """
    stopwords = stopwords_of(common_words)
    key_type = pairs.schema["pair_id"].dataType.simpleString()
    schema = pa.schema(
        [(n, pa.string()) for n in ("op", "pair_id", "defect", "language", "target")] + [("ratio", pa.float64())] + [(n, pa.bool_()) for n in ("long", "marked", "fewer", "unfinished", "usual")] + [("source", pa.string()), ("plain", pa.string()), ("refused", pa.bool_()), ("open", pa.bool_())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for op, pair_id, source, answer, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = judge_alone(op, source, answer, label, stopwords)
                    plain = unwrapped(answer) if answer else ""
                    yield op, pair_id, *found, source, _squeezed(plain) if answer else None, found.defect == "refusal", found.defect != "empty" and bool(key_of(plain))

        yield from to_batches(rows(), schema)

    fields = "op string, pair_id string, defect string, language string, target string, ratio double, long boolean, marked boolean, fewer boolean, unfinished boolean, usual boolean, source string, plain string, refused boolean, open boolean"
    judged = _saved(pairs.select("op", F.col("pair_id").cast("string").alias("pair_id"), *_PAIR_COLUMNS[2:]).mapInArrow(work, fields), "judged")
    _, told = learn_from(judged.where("plain is not null"))
    if told is not None:
        also = told.where("open").select("op", "pair_id", "plain", "source", F.lit(True).alias("told")).distinct()
        same = [judged[c].eqNullSafe(also[c]) for c in ("op", "pair_id")] + [judged["plain"] == also["plain"], F.coalesce(judged["source"], F.lit("")) == also["source"]]
        judged = judged.join(also, same, "left").select(*(judged[c] for c in judged.columns), "told")
        no = F.col("open") & F.col("told").isNotNull()
        judged = judged.withColumns({"defect": F.when(no, "refusal").otherwise(F.col("defect")), "usual": F.col("usual") & ~no})
    medians = usual_ratios(judged.where("usual"))
    size = F.col("ratio") / F.coalesce("median", F.lit(1.0))
    cut_off = F.col("marked") | (F.col("long") & (size < 0.5)) | ((size < 0.82) & (F.col("unfinished") | ((size < 0.66) & F.col("long") & F.col("fewer"))))
    told_of = judged.join(F.broadcast(medians), ["op", "language", "target"], "left").withColumn("defect", F.coalesce("defect", F.when(cut_off, "truncated")))
    return told_of.where("defect is not null").groupBy("op", "pair_id").agg(F.min("defect").alias("defect")).select("op", F.col("pair_id").cast(key_type).alias("pair_id"), "defect")


def usual_ratios(ratios: DataFrame) -> DataFrame:
    """The median of ratio by op, language and target, exactly: the first that half of the rows do not
    exceed. These are at most 2 * 11 * 10 rows."""
    kind = ["op", "language", "target"]
    so_far = Window.partitionBy(*kind).orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ratios.groupBy(*kind, "ratio").agg(F.count(F.lit(1)).alias("n")).withColumns({"_up_to": F.sum("n").over(so_far), "_all": F.sum("n").over(Window.partitionBy(*kind))})
    return counted.where("2 * _up_to >= _all").groupBy(*kind).agg(F.min("ratio").alias("median"))
