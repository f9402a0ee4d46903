"""What a caption is made of: speaker label, markup, sound annotations, fillers and words.

The functions here work on single strings inside Arrow-batched Python stages. They accept None.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import regex

from cuemill.llm.lexicon import FILLERS, SOUNDS, SPEAKER_WORDS, TITLES

_SOUND = {"".join(word.split()).casefold() for words in SOUNDS.values() for word in words}
_FILLER = {word for words in FILLERS.values() for word in words}
#: Fillers with each repeated letter written once: "hmmm", "eeh" and "uuh" are fillers too.
_REPEATED = re.compile(r"(.)\1+")
_SQUEEZED = {re.sub(r"(.)\1+", r"\1", word) for word in _FILLER if len(word) > 1}
_STARTS = {word[0] for word in _FILLER}
_UNSPACED_FILLER = regex.compile("|".join(sorted((w for code in ("zh", "ja") for w in FILLERS[code]), key=len, reverse=True)))

_VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^<>]*)>")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<\d[\d:.]*>|\{\\[^{}]*\}")
_SQUARE = re.compile(r"[\[【〔]\s*([^\[\]【】〔〕]*?)\s*[\]】〕]")
_ROUND = re.compile(r"[(（*♪]\s*([^()（）*♪]{1,40}?)\s*[)）*♪]")
_NUMBERED = re.compile(r"(?:[-–—>]+\s*)?(?:" + "|".join(SPEAKER_WORDS) + r")[\s_]*(\d+)\s*(?:[:：]|\s[-–—]\s)\s*", re.I)
_LEADING_SQUARE = re.compile(r"(?:[-–—>]+\s*)?[\[【〔]\s*([^\[\]【】〔〕]{1,40}?)\s*[\]】〕]\s*")
_LEADING_ROUND = re.compile(r"(?:[-–—>]+\s*)?[(（]\s*([^()（）]{1,24}?)\s*[)）]\s*")
_LEADING_COLON = re.compile(r"(?:[-–—>]+\s*)?([^\s:：,，.。!?！？\"“„«「()（）\[\]<>{}/]+\.?(?:\s[^\s:：,，.。!?！？\"“„«「()（）\[\]<>{}/]+\.?){0,2})\s?[:：](?!//)\s*")
_DASHES = re.compile(r"[-–—>•]+\s+")
_NUMBER_IN = re.compile(r"(?:" + "|".join(SPEAKER_WORDS) + r")[\s_]*(\d+)$", re.I)
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_DIGITS_APART = re.compile(r"(?<=\d) (?=\d)")
_VISIBLE = regex.compile(r"[^\s\p{Z}\p{C}]")


class Caption(NamedTuple):
    """Parts of a caption. ``bare`` is true if the label is only a word before a colon in a script
    without capitals, where it could also be the start of a sentence."""

    label: str | None
    text: str
    sounds: tuple[str, ...]
    bare: bool


def is_blank(text: str | None) -> bool:
    """Null, white or invisible content."""
    return text is None or _VISIBLE.search(text) is None


def sound_key(text: str) -> str | None:
    """The key of a sound annotation's inner text, if it is one."""
    key = "".join(text.split()).casefold()
    return key if key in _SOUND else None


def _name_like(text: str, rest: str) -> tuple[bool, bool]:
    """Whether words before a colon can be a name, and whether only their place says so."""
    words = text.split()
    while words and words[0].rstrip(".").casefold() in TITLES:
        words = words[1:]
    if not words:
        return False, False
    if not any(w.lower() != w.upper() for w in words):
        return len(words) <= 2 and len("".join(words)) <= 16, True
    if any(not w[0].isupper() for w in words if w.lower() != w.upper()):
        return False, False
    if len(words) > 1 and text.isupper() and rest.isupper():
        return False, False
    return True, False


def parse(text: str | None) -> Caption:
    """Split a caption into label, remaining text and sound annotations; markup is removed.

    A label stands at the start, at most with markup or annotations before it: a voice tag, a
    bracketed name, a numbered speaker, or a name before a colon. Null gives an empty caption.
    """
    if not text:
        return Caption(None, "", (), False)
    label: str | None = None
    bare = False
    sounds: list[str] = []
    if "<" in text or "{" in text:
        voice = _VOICE.search(text)
        if voice:
            label = voice.group(1).strip() or None
            text = text[: voice.start()] + text[voice.end() :]
        text = _MARKUP.sub("", text)
    text = text.strip().lstrip("\ufeff\u200b")
    for _ in range(4):
        match = None
        if text[:1] in "[【〔-–—>" and text:
            match = _LEADING_SQUARE.match(text)
            if match:
                key = sound_key(match.group(1))
                if key:
                    sounds.append(key)
                elif label is None and not _SQUARE.fullmatch(text):
                    label = match.group(1)
                else:
                    sounds.append("".join(match.group(1).split()).casefold())
                text = text[match.end() :]
                continue
        if text[:1] in "(（-–—>" and text:
            match = _LEADING_ROUND.match(text)
            if match:
                key = sound_key(match.group(1))
                inner = match.group(1)
                if key:
                    sounds.append(key)
                    text = text[match.end() :]
                    continue
                if label is None and len(inner) <= 16 and len(inner.split()) <= 2 and match.end() < len(text) and not regex.search(r"[.。!?！？,，;；\d]", inner.rstrip(".")):
                    label = inner
                    text = text[match.end() :]
                    continue
        if label is None:
            match = _NUMBERED.match(text)
            if match:
                label = "#" + match.group(1)
                text = text[match.end() :]
                continue
            match = _LEADING_COLON.match(text)
            if match:
                fits, bare = _name_like(match.group(1), text[match.end() :])
                if fits:
                    label = match.group(1)
                    text = text[match.end() :]
                    continue
                bare = False
        match = _DASHES.match(text)
        if match:
            text = text[match.end() :]
            continue
        break
    if "[" in text or "【" in text or "〔" in text:
        for match in _SQUARE.finditer(text):
            sounds.append("".join(match.group(1).split()).casefold())
        text = _SQUARE.sub(" ", text)
    if "(" in text or "（" in text or "*" in text or "♪" in text:

        def drop(match: re.Match) -> str:
            key = sound_key(match.group(1))
            if key:
                sounds.append(key)
                return " "
            return match.group(0)

        text = _ROUND.sub(drop, text)
    if label:
        numbered = _NUMBER_IN.match(label)
        if numbered:
            label = "#" + numbered.group(1)
    return Caption(label, text, tuple(sounds), bare)


def _is_filler(word: str) -> bool:
    return word in _FILLER or (1 < len(word) <= 7 and word[0] in _STARTS and not word[-1].isdigit() and _REPEATED.sub(r"\1", word) in _SQUEEZED)


def tokens(text: str) -> list[str]:
    """Lower-case words without fillers; width and compatibility forms are made equal."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    found = []
    for word in _TOKEN.findall(text.casefold()):
        if word[0] in _STARTS and _is_filler(word):
            continue
        if word[0] >= "\u2e80":
            word = _UNSPACED_FILLER.sub("", word)
            if not word:
                continue
        found.append(word)
    return found


def has_words(text: str) -> bool:
    """Whether anything but fillers is said in a caption's remaining text."""
    for match in _TOKEN.finditer(text):
        word = match.group().casefold()
        if not (word[0] in _STARTS and _is_filler(word)) and (word[0] < "\u2e80" or _UNSPACED_FILLER.sub("", word)):
            return True
    return False


def same_words_key(text: str) -> str:
    """A key that is equal for texts with the same words.

    Case, width, spaces, punctuation and fillers are gone, a word said twice in a row counts once,
    and digits that were apart stay apart.
    """
    words = tokens(text)
    kept = [word for i, word in enumerate(words) if not i or word != words[i - 1] or word[0].isdigit()]
    joined = " ".join(kept)
    return _DIGITS_APART.sub("\x1f", joined).replace(" ", "")
