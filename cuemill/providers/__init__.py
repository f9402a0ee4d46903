"""What the engine asks of models and media, and stand-ins that need neither.

A provider is a picklable object; it is sent to the executors once and prepares itself there. Real
ones (a language model, a recogniser) live outside this repository.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple, Protocol


# The default model, where providers are reached, and the variables that hold their keys.
DEFAULT_MODEL = "ollama/qwen3"
ENDPOINTS = {"ollama": "http://localhost:11434", "openai": "https://api.openai.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta/"}
KEYS = {"openai": ["OPENAI_API_KEY"], "gemini": ["GOOGLE_API_KEY", "GOOGLE_API_KEY_JSON"]}


class ModelSettings(NamedTuple):
    """Settings of a text model; nothing global is set, so several can be used in one session."""

    model: str = DEFAULT_MODEL
    max_tokens: int = 50_000
    timeout: int = 3600
    temperature: float = 0.1

    @property
    def provider(self) -> str:
        """The part of the model id before the first slash, in small letters; ollama if there is none."""
        return self.model.split("/", 1)[0].strip().lower() if "/" in self.model else "ollama"

    @property
    def name(self) -> str:
        """The part of the model id after its provider."""
        return self.model.split("/", 1)[1] if "/" in self.model else self.model

    @property
    def endpoint(self) -> str | None:
        """Where the provider is reached, if it is a known one."""
        return ENDPOINTS.get(self.provider)

    @property
    def needs_key(self) -> str | None:
        """The environment variable that should hold a key for the provider, if any."""
        return KEYS.get(self.provider, [None])[0]

    def key(self, environment: Mapping[str, str]) -> str | None:
        """The key out of an environment; ValueError if one is needed and missing."""
        names = KEYS.get(self.provider, [])
        found = next((environment[n] for n in names if environment.get(n)), None)
        if names and found is None:
            raise ValueError(f"set {' or '.join(names)} for {self.provider}")
        return found


def preset(provider: str) -> ModelSettings:
    """Settings a provider is usually asked with."""
    presets = {"ollama": ModelSettings(DEFAULT_MODEL, max_tokens=130_000), "gemini": ModelSettings("gemini/gemini-2.5-flash")}
    if provider not in presets:
        raise ValueError(f"no preset for {provider}; known are {', '.join(sorted(presets))}")
    return presets[provider]


class Request(NamedTuple):
    """What a text model is asked to do with texts."""

    task: str
    language: str
    settings: ModelSettings = ModelSettings()

    @property
    def instructions(self) -> str:
        """The task in words."""
        if self.task == "translate":
            return f"Translate the text into {self.language}."
        if self.task == "rewrite":
            return f"Turn the spoken text into written {self.language}: punctuate it, mend its grammar and keep its meaning. The answer has at least 95 % of the text's length."
        if self.task == "academic":
            return f"Put the text into formal academic {self.language}: scholarly words, no colloquial ones, a logical order. Keep its meaning, about 96 % of its words, and citations as they are."
        raise ValueError(f"no instructions for {self.task}")


class TextModel(Protocol):
    """Turns texts into texts, one for each, as a request asks."""

    def run(self, request: Request, texts: list[str]) -> list[str]: ...


class LanguageDetector(Protocol):
    """Names the language of each text by a code."""

    def detect(self, texts: list[str]) -> list[str]: ...


class Transcriber(Protocol):
    """Turns audio into a language and segments of (start in seconds, end in seconds, text)."""

    def transcribe(self, audio: bytes, language: str | None) -> tuple[str, list[tuple[float, float, str]]]: ...


class Diarizer(Protocol):
    """Says who speaks when: (speaker, start in seconds, end in seconds) of each turn."""

    def turns(self, audio: bytes) -> list[tuple[str, float, float]]: ...


class MediaFetcher(Protocol):
    """Gets the audio of an address."""

    def fetch(self, url: str) -> bytes: ...


class AudioDecoder(Protocol):
    """Turns the bytes of a video or audio file of some format into WAV data."""

    def decode(self, content: bytes, suffix: str) -> bytes: ...


class AudioSlicer(Protocol):
    """Cuts audio to ranges in milliseconds, one after the other."""

    def __call__(self, content: bytes, ranges: list[tuple[int, int]]) -> bytes: ...


class UpperCaseModel:
    """A stand-in for a text model: upper case."""

    def run(self, request: Request, texts: list[str]) -> list[str]:
        return [text.upper() for text in texts]


class ScriptDetector:
    """A stand-in for a language detector: by the script that most letters have; en for Latin."""

    # First and last letter of scripts, and a language that uses each.
    RANGES = [("぀", "ヿ", "ja"), ("一", "鿿", "zh"), ("Ѐ", "ӿ", "ru"), ("؀", "ۿ", "ar"), ("ऀ", "ॿ", "hi"), ("฀", "๿", "th")]

    def detect(self, texts: list[str]) -> list[str]:
        out = []
        for text in texts:
            counts = {code: sum(a <= c <= z for c in text) for a, z, code in self.RANGES}
            best = max(counts, key=lambda code: counts[code])
            out.append("en" if counts[best] * 2 < sum(c.isalpha() for c in text) or not counts[best] else best)
        return out


class LinesTranscriber:
    """A stand-in for a transcriber: each line of the bytes is a segment of two seconds."""

    def transcribe(self, audio: bytes, language: str | None) -> tuple[str, list[tuple[float, float, str]]]:
        lines = audio.decode("utf-8", "replace").splitlines()
        return language or "en", [(2.0 * i, 2.0 * i + 2.0, line) for i, line in enumerate(lines)]


class AlternatingDiarizer:
    """A stand-in for a diarizer: two speakers take turns of four seconds over eight."""

    def turns(self, audio: bytes) -> list[tuple[str, float, float]]:
        return [("SPEAKER_00", 0.0, 4.0), ("SPEAKER_01", 4.0, 8.0)]


class EchoModel:
    """A stand-in for a text model: the text itself behind task and language."""

    def run(self, request: Request, texts: list[str]) -> list[str]:
        return [f"[{request.task}:{request.language}] {text}" for text in texts]


class SettingsModel:
    """A stand-in for a text model: the text behind the settings it is asked with."""

    def run(self, request: Request, texts: list[str]) -> list[str]:
        s = request.settings
        return [f"[{s.provider} {s.name} {s.max_tokens} {s.timeout} {s.temperature}] {text}" for text in texts]


class FailingModel:
    """A stand-in for a text model that fails whenever a text holds ``sign``."""

    def __init__(self, inner: TextModel, sign: str):
        self._inner, self._sign = inner, sign

    def run(self, request: Request, texts: list[str]) -> list[str]:
        if any(self._sign in text for text in texts):
            raise RuntimeError("the model failed")
        return self._inner.run(request, texts)


class LinesDiarizer:
    """A stand-in for a diarizer of text as audio, two seconds a line: lines take turns between two
    speakers, two lines each; a text without lines fails."""

    def turns(self, audio: bytes) -> list[tuple[str, float, float]]:
        lines = audio.decode("utf-8", "replace").split("\n")
        if not audio.strip():
            raise ValueError("no sound")
        return [(f"SPEAKER_{i // 2 % 2:02}", 2.0 * i, 2.0 * i + 2.0) for i in range(len(lines))]


def slice_lines(content: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A stand-in for a slicer of text as audio, two seconds a line."""
    lines = content.decode("utf-8", "replace").split("\n")
    return "\n".join(line for a, b in ranges for line in lines[a // 2000 : b // 2000]).encode()


class SplitTranscriber:
    """A stand-in for a transcriber of text as audio, two seconds a line, in the language of the hint,
    else zh if the text has Han characters, else en."""

    def transcribe(self, audio: bytes, language: str | None) -> tuple[str, list[tuple[float, float, str]]]:
        text = audio.decode("utf-8", "replace")
        found = language or ("zh" if any("一" <= c <= "鿿" for c in text) else "en")
        return found, [(2.0 * i, 2.0 * i + 2.0, line) for i, line in enumerate(text.split("\n"))]


class BytesFetcher:
    """A stand-in for a fetcher: the address itself as bytes; addresses of .invalid fail."""

    def fetch(self, url: str) -> bytes:
        if ".invalid" in url:
            raise OSError("no such host")
        return url.encode()


class PlainDecoder:
    """A stand-in for a decoder: the bytes behind the name of their format; empty ones fail."""

    def decode(self, content: bytes, suffix: str) -> bytes:
        if not content:
            raise ValueError("nothing to decode")
        return suffix.encode() + b":" + content
