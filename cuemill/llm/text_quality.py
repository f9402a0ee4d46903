"""Statistics of documents and the type of text they tell: prose, list, table or junk.

Method: thresholds on the statistics are noisy labelling functions, each voting for one type or not
at all. Expectation-maximization on how the votes agree over all documents learns how often each
function fires on each type; the posterior of a document's votes gives its type.

Scale: one narrow pass computes statistics and votes. Learning needs only how often each combination
of votes occurs: at most 2^len(FUNCTIONS) rows whatever the input, some hundreds in fact. No shuffle
but that count.
"""

from __future__ import annotations

import csv
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.streams import to_batches
from cuemill.session import checkpoint

TYPES = ["prose", "list", "table", "junk"]

_TIMING = re.compile(r"\s*(?:\d+|WEBVTT.*|NOTE.*|.*-->.*)\s*$")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_URL = re.compile(r"https?://[!-~]+")
_HEADING = re.compile(r"\s*#{1,6}\s")
_RULE = re.compile(r"[-=*_#|+:\s]*$")
_ITEM = re.compile(r"\s*(?:[-*•·–—＊◦‣▪+☐☑☒✓✗]\s*|\[[ xX]?\]\s*|[(（]?(?:\d{1,4}|[a-zA-Z])[.)）、:：]\s*|\d{1,2}:\d{2}(?::\d{2})?\s+)(?=\S)")
_KEY = re.compile(r"\s*(?:- )?\"?[A-Za-z_][\w-]*\"?:(?:\s|$)")
_ENDS = frozenset(".!?…。！？؟।۔๏")
_CLOSING = "\"'”’»」』)）]*_~ \t\r　"
_TERMINATOR = re.compile(r"[.!?…؟۔](?=[\s\"'”’»」』)）\]*_~]|$)|[。！？।]")
_MARKS = "\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_SOLID = re.compile(rf"[\w{_MARKS}]+")
_LETTERS = re.compile(r"[^\W\d_]")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]+")
_WORD_EDGE = ".,;:!?…\"'“”„‘’«»()[]{}<>*_~#|/\\-–—=+¿¡؟،؛।"
_strip_edge = methodcaller("strip", _WORD_EDGE)
_NUMBER_CELL = re.compile(r"[\s|\"]*[-+]?\d[\d.,:]*\s*%?[\s|\"]*$")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]{3,}")
_VOWEL = re.compile(r"[aeiouyAEIOUYÀ-ÆÈ-ÏÒ-ÖÙ-Ýà-æè-ïò-öù-ý]")
#: Latin words without a vowel.
_NO_VOWEL = "".join(c for c in map(chr, range(0x41, 0x100)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c) and not _VOWEL.match(c))
_VOWELLESS = re.compile(rf"(?<![A-Za-zÀ-ÖØ-öø-ÿ])[{_NO_VOWEL}]{{3,}}(?![A-Za-zÀ-ÖØ-öø-ÿ])")
_BORDER = re.compile(r"\s*[|+][-=+|:\s]*[-=|]{2}[-=+|:\s]*$")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_LEADER = re.compile(r"\s*(?:\.{4,}|…{2,}|_{4,}|·{4,})\s*")
_INLINE = [", ", "; ", " / ", " · ", " | ", "、", "，", " • ", "；", "، "]
_MOJIBAKE = re.compile(r"[\x80-\x9f]|[ÃÂâàåæçèé][\x80-\xbf]")
_LOST = re.compile(r"[�□]")

STATISTICS = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "terminators_per_word", "common_share", "words_per_line", "item_share", "short_line_share", "key_share", "column_share", "number_cell_share", "inline_items", "encoded_share", "broken_share", "vowelless_share", "markup_share", "variety"]


def common_pattern(common: list[str]) -> tuple[frozenset[str], re.Pattern]:
    """Common words of spaced scripts as a set, those of scripts without spaces as a pattern."""
    unspaced = sorted({w for w in common if _UNSPACED.match(w)}, key=lambda w: (-len(w), w))
    return frozenset(w.lower() for w in common if not _UNSPACED.match(w)), re.compile("|".join(map(re.escape, unspaced)) or r"(?!)")


def _columns(rows: list[str]) -> tuple[float, float]:
    """The share of rows with as many cells as most, by the separator that fits best, and the share
    of rows with a number for a cell. A separator must make at least two cells; those anywhere in the
    rows are tried."""
    best = (0.0, 0.0)
    if len(rows) < 3:
        return best
    body = "\n".join(rows)
    splits: list[list[list[str]]] = [[row.split(mark) for row in rows] for mark in ("\t", "|", ";") if mark in body]
    if "  " in body:
        splits.append([_GAP.split(row) for row in rows])
    if any(mark in body for mark in ("....", "……", "____", "····")):
        splits.append([_LEADER.split(row) for row in rows])
    by_comma = len(splits)
    if "," in body:
        try:
            splits.append(list(csv.reader(rows)))
        except csv.Error:
            splits.append([row.split(",") for row in rows])
    for i, cells in enumerate(splits):
        widths = Counter(map(len, cells))
        width, count = widths.most_common(1)[0]
        if width >= 2 and count / len(rows) >= 0.3:
            numbers = sum(any(_NUMBER_CELL.match(c) for c in row) for row in cells) / max(len(cells), 1)
            if i < by_comma or width >= 3 or numbers >= 0.5:
                best = max(best, (count / len(rows), numbers))
    return best


def _inline_items(body: str) -> int:
    most = 0
    for mark in _INLINE:
        if body.count(mark) >= 4:
            parts = body.split(mark)
            if sorted(map(len, parts))[len(parts) // 2] <= 40:
                most = max(most, len(parts))
    return most


def statistics(text: str, common: frozenset[str], unspaced_common: re.Pattern) -> dict[str, float]:
    """The statistics of one text that is not blank."""
    text = text.lstrip("﻿")
    bare = _TAG.sub(" ", text) if "<" in text else text
    lines = [line for line in bare.splitlines() if line.strip()]
    subtitles = "-->" in text and bool(lines) and "," not in lines[0]
    if subtitles:
        lines = [line for line in lines if not _TIMING.match(line)]
    body = "\n".join(lines)
    core = _URL.sub(" ", body) if "://" in body else body
    solid = "".join(text.split())
    solid_core = "".join(core.split())
    n, n_core = max(len(solid), 1), max(len(solid_core), 1)
    digits = sum(map(solid.count, "0123456789"))
    alphanumeric = sum(map(len, _SOLID.findall(solid_core))) - solid_core.count("_")
    unspaced = _UNSPACED.findall(core)
    unspaced_chars = sum(map(len, unspaced))
    common_hits = sum(map(len, unspaced_common.findall(" ".join(unspaced)))) if unspaced else 0
    tokens = core.split()
    words = map(_strip_edge, (_UNSPACED.sub(" ", core) if unspaced else core).lower().split())
    spaced = [w for w in words if w and (w[0].isalpha() or (_LETTERS.match(w) and not w.isdigit()))]
    known = sum(map(common.__contains__, spaced))
    n_words = len(spaced) + unspaced_chars / 2
    headless = [line for line in lines if not _HEADING.match(line) and not _RULE.match(line)] or lines
    n_lines = max(len(headless), 1)
    thai = bool(unspaced) and "\u0e00" <= unspaced[0][0] <= "\u0e7f"
    short_limit = 26 if unspaced_chars > 0.5 * alphanumeric and not thai else 60
    ends = items = shorts = keys = 0
    for line in headless:
        ends += line.rstrip(_CLOSING)[-1:] in _ENDS
        if len(line) <= short_limit + 12:
            item = _ITEM.match(line)
            begin = item.end() if item else 0
            if len(line) - begin <= short_limit and not _TERMINATOR.search(line, begin):
                shorts += 1
                items += item is not None
        if ":" in line and len(line) <= 120:
            keys += _KEY.match(line) is not None
    column_share, number_share = _columns([line.strip().strip("|") for line in headless if not _BORDER.match(line)])
    n_ends = len(_TERMINATOR.findall(core))
    inline = _inline_items(body) if len(headless) <= 3 and n_ends <= 1 else 0
    lengths = list(map(len, tokens))
    encoded = 0 if max(lengths, default=0) < 40 else sum(len(t) for t in tokens if len(t) >= 40 and t.isascii() and t.count(".") < len(t) // 4 and any(c.isalnum() for c in t))
    if digits and len(tokens) >= 8 and lengths.count(2) > 0.8 * len(tokens) and sum(len(t) == 2 and all(c in "0123456789abcdefABCDEF" for c in t) for t in tokens) > 0.8 * len(tokens):
        encoded = n
    latin = _LATIN_WORD.findall(core)
    vowelless = len(_VOWELLESS.findall(core)) / len(latin) if len(latin) >= 5 else 0.0
    variety = 1.0
    raw = solid.encode("utf-8", "replace")
    if len(solid) >= 40 and len(zlib.compress(raw, 1)) < 0.3 * len(raw) + 12:
        # Different 4-grams of a text grow more slowly than its length.
        variety = len({solid[i : i + 4] for i in range(len(solid) - 3)}) / (min(len(solid), 400) * max(1.0, len(solid) / 400) ** 0.7)
    broken = 0 if solid.isascii() else max(len(_LOST.findall(solid)) * 1.5, len(_MOJIBAKE.findall(solid)) * 2.0)
    return {
        "n_chars": float(len(text)),
        "n_words": n_words,
        "mean_word_length": sum(map(len, spaced)) / max(len(spaced), 1),
        "symbol_ratio": max(0.0, 1 - alphanumeric / n_core),
        "digit_ratio": digits / n,
        "line_end_share": ends / n_lines,
        "terminators_per_word": n_ends / max(n_words, 1.0),
        "common_share": (known + common_hits / 2) / max(n_words, 1.0),
        "words_per_line": n_words / n_lines,
        "item_share": items / n_lines,
        "short_line_share": shorts / n_lines if n_lines >= 4 and not subtitles else 0.0,
        "key_share": keys / n_lines if n_lines >= 4 else 0.0,
        "column_share": column_share,
        "number_cell_share": number_share,
        "inline_items": float(inline),
        "encoded_share": min(1.0, encoded / n),
        "broken_share": broken / n,
        "vowelless_share": vowelless,
        "markup_share": 1.0 - len("".join(bare.split())) / n if n_words < 2 else 0.0,
        "variety": variety,
    }


#: Labelling functions: the type each votes for, and when. Thresholds are on the statistics above.
FUNCTIONS = [
    ("line_ends", "prose", lambda s: s["line_end_share"] >= 0.45 and s["n_words"] >= 3),
    ("terminators", "prose", lambda s: 0.01 <= s["terminators_per_word"] <= 0.5 and s["item_share"] < 0.6 and s["encoded_share"] < 0.5),
    ("common_words", "prose", lambda s: s["common_share"] >= 0.22 and s["encoded_share"] < 0.5),
    ("long_lines", "prose", lambda s: s["words_per_line"] >= 7 and s["inline_items"] < 5 and s["column_share"] < 0.7 and s["common_share"] >= 0.08 and s["encoded_share"] < 0.5),
    ("items", "list", lambda s: s["item_share"] >= 0.6),
    ("short_lines", "list", lambda s: s["short_line_share"] >= 0.8 and s["number_cell_share"] < 0.5 and s["n_words"] >= 4 and s["encoded_share"] < 0.5),
    ("inline_items", "list", lambda s: s["inline_items"] >= 5),
    ("keys", "list", lambda s: s["key_share"] >= 0.6),
    ("columns", "table", lambda s: s["column_share"] >= 0.7),
    ("number_cells", "table", lambda s: s["number_cell_share"] >= 0.6 and s["column_share"] >= 0.5),
    ("digits", "table", lambda s: s["digit_ratio"] >= 0.15 and s["number_cell_share"] >= 0.5),
    ("symbols", "junk", lambda s: s["symbol_ratio"] >= 0.6),
    ("wordless", "junk", lambda s: s["n_words"] < 1),
    ("encoded", "junk", lambda s: s["encoded_share"] >= 0.6),
    ("broken", "junk", lambda s: s["broken_share"] >= 0.1),
    ("vowelless", "junk", lambda s: s["vowelless_share"] >= 0.5),
    ("markup", "junk", lambda s: s["markup_share"] >= 0.8),
    ("one_thing", "junk", lambda s: s["variety"] <= 0.12),
    ("no_common", "junk", lambda s: s["common_share"] == 0 and s["item_share"] < 0.5 and s["short_line_share"] < 0.8 and s["inline_items"] < 5 and s["column_share"] < 0.5 and s["key_share"] < 0.5 and s["n_words"] >= 8),
]


def votes_of(values: dict[str, float]) -> int:
    """The votes of all labelling functions as bits."""
    return sum(1 << i for i, (_, _, fires) in enumerate(FUNCTIONS) if fires(values))


def learn(patterns: dict[int, int], rounds: int = 60, strength: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Priors of the types and the rates at which functions fire on them, by expectation-maximization.

    The start is that a function fires on most texts of its type and few others. That start also acts
    as a share ``strength`` of all documents (at least 20), so that rare types keep their meaning:
    left to the data alone, lists of names drift towards junk.
    """
    bits = np.array([[p >> j & 1 for j in range(len(FUNCTIONS))] for p in patterns], float).reshape(-1, len(FUNCTIONS))
    weight = np.array(list(patterns.values()), float)
    own = np.array([[kind == voted for kind in TYPES] for _, voted, _ in FUNCTIONS])
    start = np.where(own, 0.5, 0.02)
    prior, rate = np.array([0.85, 0.05, 0.05, 0.05]), start
    pseudo = max(20.0, strength * weight.sum())
    base = prior
    for _ in range(rounds):
        gamma = _posterior(bits, prior, rate) * weight[:, None]
        mass = gamma.sum(0)
        prior = (mass + pseudo * base) / (mass + pseudo * base).sum()
        rate = (bits.T @ gamma + pseudo * start) / (mass + pseudo)
        rate = np.where(own, np.maximum(rate, 0.05), np.minimum(rate, 0.6))
    return prior, rate


def _posterior(bits: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    score = np.log(prior) + bits @ np.log(rate) + (1 - bits) @ np.log1p(-rate)
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def quality_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, votes and the statistics of each document whose text is not blank.

    Null, empty and blank texts give no row. ``common_words`` is a short list by nature; it is read to
    the driver, and more than 100 000 rows are an error. Repeated rows are measured each.
    """
    common = [row[0] for row in common_words.select("word").where("word is not null").distinct().limit(100_001).collect()]
    if len(common) > 100_000:
        raise ValueError("common_words is meant to be a short list")
    common_set, unspaced = common_pattern(common)
    spec = (common_set, unspaced.pattern)
    key_type = documents.schema[key].dataType.simpleString()
    schema = pa.schema([("key", pa.string()), ("votes", pa.int64()), *[(name, pa.float64()) for name in STATISTICS]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pattern = spec[0], re.compile(spec[1])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if content is None or not content.strip().strip("﻿​"):
                        continue
                    values = statistics(content, words, pattern)
                    yield name, votes_of(values), *(values[s] for s in STATISTICS)

        yield from to_batches(rows(), schema)

    columns = documents.select(documents[key].cast("string").alias("key"), documents[text].cast("string").alias("text"))
    measured = columns.mapInArrow(work, "key string, votes bigint, " + ", ".join(f"{s} double" for s in STATISTICS))
    return measured.withColumn("key", measured["key"].cast(key_type)).withColumnRenamed("key", key)


def text_types(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, text_class (prose, list, table, junk) and confidence of each document that is not blank."""
    measured = checkpoint(quality_statistics(documents, common_words, key, text).select(key, "votes"))
    patterns = {int(row[0]): int(row[1]) for row in measured.groupBy("votes").count().collect()}
    if not patterns:
        return measured.select(key, F.lit("").alias("text_class"), F.lit(0.0).alias("confidence")).limit(0)
    prior, rate = learn(patterns)
    bits = np.array([[p >> j & 1 for j in range(len(FUNCTIONS))] for p in patterns], float)
    posterior = _posterior(bits, prior, rate)
    known = [(p, TYPES[int(row.argmax())], float(row.max())) for p, row in zip(patterns, posterior, strict=True)]
    lookup = F.create_map(*[x for p, kind, sure in known for x in (F.lit(p), F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("sure")))])
    typed = measured.withColumn("_t", F.element_at(lookup, F.col("votes"))) if len(known) <= 512 else measured.join(F.broadcast(measured.sparkSession.createDataFrame([(p, (k, c)) for p, k, c in known], "votes bigint, _t struct<kind: string, sure: double>")), "votes")
    return typed.select(key, F.col("_t.kind").alias("text_class"), F.col("_t.sure").alias("confidence"))
