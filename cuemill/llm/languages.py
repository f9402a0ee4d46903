"""Languages of texts and of their parts, with confidence, where labels are missing or wrong.

Method: nearest-centroid classification. A part of a text is a normalised TF-IDF vector of character
n-grams (trigrams with word edges, and single characters beyond the Latin script), hashed to a fixed
number of dimensions. Each language has several centroids, found by clustering; a part has the
language of the centroid with the highest cosine, unless that is further off than the training parts
of like length, which rejects the part.

Training reads a bounded sample of labelled documents (``SAMPLE`` rows by a hash of their key; whole
texts). Its labels may be wrong: clusters form across labels first, then each takes the language that
most of its sharply labelled members share. Classification reads everything.

Scale: parts are classified in the scan's own partitions, without shuffle. Only (item, part, language)
is shuffled: once to count a part delivered twice once, once to count languages per item, with
partial counts before, and once to compare parts with their item's main language. That join's key
holds the block of ``BLOCK`` part numbers too, for which the main language is repeated, so that an
item with a third of all parts makes no large group there either.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.captions import has_words, is_blank, parse
from cuemill.llm.lexicon import LANGUAGES, language_of_label
from cuemill.llm.streams import to_batches
from cuemill.session import checkpoint

#: Labelled documents in the training sample.
SAMPLE = 4000
#: Part numbers of an item that are compared with its main language together.
BLOCK = 4096
#: Dimensions of the hashed vectors.
BITS = 16
DIMENSIONS = 1 << BITS
#: Clusters per language.
CLUSTERS = 3
#: Length classes for rejection, by number of n-grams.
LENGTHS = np.array([0, 6, 12, 24, 48, 96, 192, 1 << 30])
#: How much closer the best language must be than the main one to tell a foreign part, by length class.
MARGIN = np.array([0.9, 0.2, 0.09, 0.06, 0.045, 0.035, 0.03])

_HTTP = re.compile(r"https?[:/]+[!-~]+")
#: Addresses, file names and words with digits, and signs that a text has any.
_JOINED_OR_NUMBER = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(?:[./_\\:][A-Za-z0-9-]++)+|(?<![A-Za-z_])[A-Za-z_]*[0-9][A-Za-z0-9_]*")
_SIGN = re.compile(r"[0-9]|[./_\\:][A-Za-z-]")
#: Signs that a caption may have a label, markup or an annotation.
_DRESSED = re.compile(r"[\[【〔(（*♪<{:：>]|^\s*[-–—]|\s[-–—]\s")
_ASIDE = re.compile(r"[(（][^()（）]{1,60}[)）]")
_TAG = re.compile(r"<[^<>]*>")
_KEY = re.compile(r"^\s*(?:- )?[A-Za-z_]+:(?=\s|$)", re.M)
_HEAD = re.compile(r"^(?:WEBVTT.*|,?[A-Z][a-z]+(?:,[A-Z][a-z]+)+\s*)$", re.M)
_BLANK_LINE = re.compile(r"\n(?:[^\S\n]*\n)+")


def _lower_table() -> np.ndarray:
    table = np.full(0x30000, 32, np.uint32)
    for code in range(0x30000):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    table[10] = 10
    return table


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, dimension, count) of all n-grams of texts, sorted by text and dimension."""
    if not _TABLE:
        _TABLE.append(_lower_table())
    joined = "\n".join([t.replace("\n", " ") for t in texts]) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _TABLE[0][np.minimum(codes, 0x2FFFF)]
    codes = np.concatenate([np.array([10], np.uint32), codes])
    blank = (codes == 32) | (codes == 10)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~((codes[1:] == 32) & blank[:-1])
    codes = codes[keep]
    text = np.cumsum(codes == 10) - 1
    edge = np.where(codes == 10, np.uint32(32), codes)
    a, b, c = edge[:-2], edge[1:-1], edge[2:]
    with np.errstate(over="ignore"):
        three = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
        three = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        one = edge * np.uint32(0x27D4EB2F)
        one = (one ^ (one >> np.uint32(13))) * np.uint32(0x165667B1)
    inner = (codes[1:-1] != 10) & (codes[1:-1] != 32)
    far = codes >= 0x370
    shift = np.uint32(32 - BITS)
    keys = np.concatenate([text[1:-1][inner].astype(np.int64) << BITS | (three[inner] >> shift).astype(np.int64), text[far].astype(np.int64) << BITS | (one[far] >> shift).astype(np.int64)])
    keys.sort()
    if not len(keys):
        return keys, keys, keys
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    starts = np.flatnonzero(first)
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    unique = keys[starts]
    return unique >> BITS, unique & (DIMENSIONS - 1), counts


class Model(NamedTuple):
    """Weights (dimensions x centroids, the IDF included), IDF, language number of each centroid,
    and per language and length class the least cosine of training parts."""

    weights: np.ndarray
    idf: np.ndarray
    language: np.ndarray
    least: np.ndarray


def _similarities(text: np.ndarray, dimension: np.ndarray, count: np.ndarray, n: int, weights: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Cosines of ``n`` texts with all centroids."""
    out = np.zeros((n, weights.shape[1]), np.float32)
    tf = np.sqrt(count).astype(np.float32)
    norm = np.zeros(n)
    for begin in range(0, len(text), 200_000):
        part = slice(begin, begin + 200_000)
        rows = text[part]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        np.add.at(out, rows[starts], np.add.reduceat(weights[dimension[part]] * tf[part, None], starts, axis=0))
        np.add.at(norm, rows[starts], np.add.reduceat((tf[part] * idf[dimension[part]]) ** 2.0, starts))
    return out / np.maximum(np.sqrt(norm), 1e-9)[:, None].astype(np.float32)


class Found(NamedTuple):
    """What was found about texts, as arrays: language number (-1 if rejected or without letters),
    confidence (the best cosine's share of the two best), number of n-grams, cosines by language."""

    language: np.ndarray
    confidence: np.ndarray
    size: np.ndarray
    cosines: np.ndarray


def classify(texts: list[str], model: Model) -> Found:
    """The language of each text."""
    n = len(texts)
    text, dimension, count = grams(texts)
    near = _similarities(text, dimension, count, n, model.weights, model.idf)
    cosines = np.stack([near[:, model.language == i].max(1) if (model.language == i).any() else np.zeros(n, np.float32) for i in range(len(LANGUAGES))], 1)
    size = np.bincount(text, count, n).astype(np.int64) if len(text) else np.zeros(n, np.int64)
    best = cosines.argmax(1)
    rows = np.arange(n)
    top = cosines[rows, best]
    others = cosines.copy()
    others[rows, best] = 0
    sure = top / np.maximum(top + others.max(1), 1e-9)
    fits = (size > 0) & (top >= model.least[best, np.searchsorted(LENGTHS, size, "right") - 1])
    return Found(np.where(fits, best, -1), sure, size, cosines)


def train(vectors: list[tuple[str, np.ndarray, np.ndarray]], pieces: list[list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """A model from (label, dimensions, counts) of documents and the n-grams of pieces of them."""
    n = len(vectors)
    df = np.zeros(DIMENSIONS)
    for _, dims, _ in vectors:
        df[dims] += 1
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    units = []
    for _, dims, counts in vectors:
        x = np.sqrt(counts).astype(np.float32) * idf[dims]
        units.append(x / max(float(np.sqrt((x * x).sum())), 1e-9))
    labels = np.array([LANGUAGES.index(label) for label, _, _ in vectors])

    def near(centroids: np.ndarray) -> np.ndarray:
        return np.stack([units[i] @ centroids[vectors[i][1]] for i in range(n)]) if n else np.zeros((0, centroids.shape[1]))

    def means(member: np.ndarray, k: int) -> np.ndarray:
        c = np.zeros((DIMENSIONS, k), np.float32)
        for i in range(n):
            if member[i] >= 0:
                c[vectors[i][1], member[i]] += units[i]
        return c / np.maximum(np.sqrt((c * c).sum(0)), 1e-9)

    member = labels.copy()
    for _ in range(5):
        member = near(means(member, len(LANGUAGES))).argmax(1)
    votes = np.zeros((len(LANGUAGES), len(LANGUAGES)))
    np.add.at(votes, (member, labels), 1)
    true = np.array([row.argmax() if row.sum() else i for i, row in enumerate(votes)])[member] if n else member
    cluster = np.full(n, -1)
    language: list[int] = []
    for lang in range(len(LANGUAGES)):
        rows = np.flatnonzero(true == lang)
        if not len(rows):
            continue
        k = min(CLUSTERS, max(1, len(rows) // 20))
        base = len(language)
        language += [lang] * k
        cluster[rows] = base + np.arange(len(rows)) % k
    for _ in range(6):
        centroids = means(cluster, len(language))
        closeness = near(centroids)
        closeness[np.array(language)[None, :] != true[:, None]] = -1
        cluster = closeness.argmax(1)
    centroids = means(cluster, max(len(language), 1))
    weights = centroids * idf[:, None]
    least = np.zeros((len(LANGUAGES), len(LENGTHS) - 1), np.float32)
    found: dict[tuple[int, int], list[float]] = {}
    for i, parts in enumerate(pieces):
        for dims, counts in parts:
            tf = np.sqrt(counts).astype(np.float32)
            norm = float(np.sqrt(((tf * idf[dims]) ** 2).sum()))
            cos = (tf @ weights[dims]) / max(norm, 1e-9)
            own = cos[np.array(language) == true[i]]
            found.setdefault((int(true[i]), int(np.searchsorted(LENGTHS, counts.sum(), "right") - 1)), []).append(float(own.max()) if len(own) else 0.0)
    for (lang, length), values in found.items():
        least[lang, length] = 0.6 * np.quantile(values, 0.02)
    return Model(weights.astype(np.float32), idf, np.array(language or [0]), least)


def _without_asides(text: str) -> str:
    """A text without short bracketed phrases, which may be foreign, unless they are most of it."""
    if "(" in text or "（" in text:
        rest = _ASIDE.sub(" ", text)
        if 2 * len(rest) >= len(text):
            return rest
    return text


def _without_names(text: str) -> str:
    """A text with a space for each address, file name and word with digits."""
    if "http" in text:
        text = _HTTP.sub(" ", text)
    return _JOINED_OR_NUMBER.sub(" ", text) if _SIGN.search(text) else text


def clean_block(text: str) -> str:
    """The words of a part of a document: no markup, addresses, file names, keys and numbers."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if ":" in text:
        text = _KEY.sub(" ", text)
    if "," in text or "WEBVTT" in text:
        text = _HEAD.sub(" ", text)
    return _without_names(_without_asides(text))


def clean_caption(text: str | None) -> str:
    """The words of a caption; empty if it has none."""
    if not text:
        return ""
    said = parse(text).text if _DRESSED.search(text) else text
    return _without_names(_without_asides(said)) if has_words(said) else ""


def blocks(text: str | None) -> list[str]:
    """The non-blank pieces between blank lines."""
    if not text:
        return []
    plain = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    return [block for block in _BLANK_LINE.split(plain) if not is_blank(block)]


def _label(label: Column) -> Column:
    """The language that a label means, in Arrow batches; each spelling of a batch is looked up once."""

    @F.pandas_udf("string")
    def known(labels):
        import pandas as pd

        meant = {spelling: language_of_label(spelling) for spelling in labels.dropna().unique()}
        return pd.Series([meant.get(x) if isinstance(x, str) else None for x in labels], dtype=object)

    return known(label)


def train_on(documents: DataFrame, *, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model from ``sample`` labelled documents, those with the least hashes of their key.

    Labels are used as far as they name one of the ten languages; a key's repeated rows count once. The
    vectors are made on the executors; the driver gets at most ``sample`` of them, each with at most
    ``DIMENSIONS`` entries.
    """
    labelled = documents.where(f"{text} is not null and {label} is not null").select(F.xxhash64(key).alias("h"), F.col(label).alias("label"), F.col(text).alias("text")).where(F.length("text") > 40)
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return train([], [])
    chosen = labelled.where(F.col("h") <= last).groupBy("h").agg(F.min(F.struct("label", "text")).alias("d")).select("h", "d.label", "d.text")
    schema = pa.schema([("h", pa.int64()), ("label", pa.string()), ("dims", pa.binary()), ("counts", pa.binary()), ("parts", pa.list_(pa.binary()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for h, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lang = language_of_label(name)
                    if lang not in LANGUAGES:
                        continue
                    parts = [clean_block(b) for b in blocks(content)]
                    _, dims, counts = grams([" ".join(parts)])
                    if not len(dims):
                        continue
                    cut = []
                    for size, part in zip((4, 8, 16, 32, 64, 150, 400), (p for _ in range(7) for p in parts if p.strip()), strict=False):
                        _, d, c = grams([part.strip()[:size]])
                        if len(d):
                            cut.append(d.astype(np.int32).tobytes() + c.astype(np.int32).tobytes())
                    yield h, lang, dims.astype(np.int32).tobytes(), np.minimum(counts, 1 << 30).astype(np.int32).tobytes(), cut

        yield from to_batches(rows(), schema, 256)

    got = sorted(chosen.mapInArrow(work, "h bigint, label string, dims binary, counts binary, parts array<binary>").collect())
    as_ints = lambda raw: np.frombuffer(bytes(raw), np.int32)
    vectors = [(row.label, as_ints(row.dims), as_ints(row.counts)) for row in got]
    halves = lambda raw: (raw[: len(raw) // 2], raw[len(raw) // 2 :])
    return train(vectors, [[halves(as_ints(p)) for p in row.parts] for row in got])


_PARTS_SQL = "item_type string, item_id bigint, part_no bigint, lang string, confidence float, size int, cosines binary"
_CODES = pa.array(LANGUAGES, pa.string())
#: Cosines are kept as 16-bit numbers of this many parts.
FINE = 60_000


def parts_with_languages(frame: DataFrame, model: Model, item_type: str, columns: list[str]) -> DataFrame:
    """item_type, item_id, part_no, lang, confidence, size and cosines of the parts that have words.

    ``columns`` name, for documents, the key and the text; for files, file, cue index and content; for
    transcripts, the key and the array of texts.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def split(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
        lists = [c.to_pylist() for c in batch.columns]
        if item_type == "document":
            for key, content in zip(*lists, strict=True):
                for number, block in enumerate(blocks(content), 1):
                    yield key, number, clean_block(block)
        elif item_type == "file":
            for key, index, content in zip(*lists, strict=True):
                yield key, index, clean_caption(content)
        else:
            for key, texts in zip(*lists, strict=True):
                for number, content in enumerate(texts or [], 1):
                    yield key, number, clean_caption(content)

    def flush(keys: list[int], numbers: list[int], texts: list[str]) -> pa.RecordBatch:
        found = classify(texts, shared.value)
        kept = np.flatnonzero(found.size > 0)
        language = found.language[kept]
        fine = np.clip(found.cosines[kept] * FINE, 0, 65535).astype(">u2")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([item_type] * len(kept), pa.string()),
                pa.array(np.array(keys, np.int64)[kept]),
                pa.array(np.array(numbers, np.int64)[kept]),
                _CODES.take(pa.array(np.maximum(language, 0), pa.int64(), mask=language < 0)),
                pa.array(found.confidence[kept].astype(np.float32)),
                pa.array(np.minimum(found.size[kept], 1 << 30).astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((np.arange(len(kept) + 1) * 2 * len(LANGUAGES)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(fine))]),
            ],
            names=["item_type", "item_id", "part_no", "lang", "confidence", "size", "cosines"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        numbers: list[int] = []
        texts: list[str] = []
        amount = 0
        for batch in batches:
            for key, number, text in split(batch):
                if text and not text.isspace():
                    keys.append(key)
                    numbers.append(number)
                    texts.append(text)
                    amount += len(text)
                    if amount > 250_000:
                        yield flush(keys, numbers, texts)
                        keys, numbers, texts, amount = [], [], [], 0
        if keys:
            yield flush(keys, numbers, texts)

    return frame.select(*columns).mapInArrow(work, _PARTS_SQL)


def item_parts(documents: DataFrame, cues: DataFrame, transcripts: DataFrame, model: Model) -> DataFrame:
    """The parts of all documents, files and transcripts that have words; each part once."""
    of_documents = parts_with_languages(documents.where("doc_id is not null and text is not null"), model, "document", ["doc_id", "text"])
    of_files = parts_with_languages(cues.where("file_id is not null and cue_index is not null and content is not null"), model, "file", ["file_id", "cue_index", "content"])
    texts = transcripts.where("transcript_id is not null").select("transcript_id", F.transform("segments", lambda s: s["text"]).alias("texts"))
    of_transcripts = parts_with_languages(texts, model, "transcript", ["transcript_id", "texts"])
    every = of_documents.unionByName(of_files).unionByName(of_transcripts)
    return every.groupBy("item_type", "item_id", "part_no").agg(F.max_by(F.struct("lang", "confidence", "size", "cosines"), F.struct("size", "lang")).alias("p")).select("item_type", "item_id", "part_no", "p.*")


def main_languages(parts: DataFrame) -> DataFrame:
    """item_type, item_id, main, confidence, last_part: the language of most parts; of ties the one with
    most text, then the first in the alphabet. The confidence is the sum of its parts' confidences
    over the number of all parts with words, rejected ones included. An item whose parts are all
    rejected has a null language with confidence 0."""
    counts = parts.groupBy("item_type", "item_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.col("confidence").cast("double")).alias("sure"), F.max("part_no").alias("last"))
    rank = F.struct(F.col("lang").isNotNull(), F.col("n"), F.col("size"), -F.array_position(F.array(*map(F.lit, sorted(LANGUAGES))), F.coalesce("lang", F.lit(""))))
    best = F.max_by(F.struct("lang", "sure"), rank).alias("best")
    found = counts.groupBy("item_type", "item_id").agg(best, F.sum("n").alias("parts"), F.max("last").alias("last_part"))
    return found.select("item_type", "item_id", F.col("best.lang").alias("main"), F.when(F.col("best.lang").isNull(), 0.0).otherwise(F.col("best.sure") / F.col("parts")).alias("confidence"), "last_part")


def foreign_parts(parts: DataFrame, mains: DataFrame) -> DataFrame:
    """Parts in another language than their item's main one: item_type, item_id, part_no, lang, confidence.

    A part is foreign if its language's cosine exceeds the main language's by a margin, which is
    larger for short parts.
    """
    blk = F.floor(F.col("part_no") / BLOCK).cast("bigint")
    repeated = mains.where("main is not null").select("item_type", "item_id", "main", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_part") / BLOCK).cast("bigint"))).alias("blk"))
    other = parts.where("lang is not null").withColumn("blk", blk).join(repeated.hint("shuffle_hash"), ["item_type", "item_id", "blk"]).where("lang <> main")
    position = F.create_map(*[x for i, code in enumerate(LANGUAGES) for x in (F.lit(code), F.lit(2 * i + 1))])
    cosine = lambda lang: F.conv(F.hex(F.substring(F.col("cosines"), F.element_at(position, F.col(lang)), F.lit(2))), 16, 10).cast("double") / FINE
    lead = cosine("lang") - cosine("main")
    margin = F.lit(float(MARGIN[-1]))
    for bound, value in reversed(list(zip(LENGTHS[1:-1].tolist(), MARGIN[:-1].tolist(), strict=True))):
        margin = F.when(F.col("size") < bound, F.lit(value)).otherwise(margin)
    return other.where(lead >= margin).select("item_type", "item_id", "part_no", "lang", "confidence")


def label_cases(mains: DataFrame, labels: DataFrame) -> DataFrame:
    """Items whose label (item_type, item_id, label; one row each) names no language or another one."""
    named = _label(F.col("label"))
    return mains.where("main is not null").join(labels, ["item_type", "item_id"]).withColumn("named", named).where(~F.col("named").eqNullSafe(F.col("main")))
