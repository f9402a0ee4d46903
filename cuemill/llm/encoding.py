"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: the vocabulary is serialised directly as a sentencepiece BPE model: pieces are the byte
strings written with one printable character per byte, their scores the negative ranks, the
normaliser the identity. Texts are cut into pre-tokens, which are encoded once each and remembered;
decoding is the inverse mapping.

Scale: no shuffle; each row is encoded on its own in Arrow batches. The vocabulary (a few MB, fixed)
is read on the driver and broadcast, so executors need no files. The memory of a worker is bounded:
its table of pre-tokens starts anew when it holds more than ``MEMORY`` entries or 16 times as many ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMORY = 400_000
#: Longer pre-tokens are encoded but not remembered.
LONGEST_REMEMBERED = 64


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    """The public pre-tokenisation pattern of the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(0x100):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(0x100)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must count up from 0")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """A field in protocol buffers' wire format: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def bpe_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the last id is for unknowns.

    Fields by number: pieces 1 (text 1, score 2, type 3), trainer 2 (model type 3 with 2 for BPE,
    vocabulary size 4, unknown id 40, no begin, end and padding 41 to 43), normaliser 3 (name 1, and
    3 to 5 switched off: dummy prefix, extra white space, escaped white space).
    """
    symbols = byte_symbols()
    unknown = len(tokens)
    absent = (1 << 64) - 1
    parts = [_field(1, _field(1, "".join(symbols[b] for b in token)) + _field(2, -float(rank))) for rank, token in enumerate(tokens)]
    parts.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    parts.append(_field(2, _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, absent) + _field(42, absent) + _field(43, absent)))
    parts.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(parts)


def ascii_pattern(pattern: str) -> str | None:
    """A pattern with Unicode properties and white space spelled out as ASCII characters, so that the
    standard library, which is faster, matches the same in ASCII texts; None if it can't take it."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        escape = _ESCAPE.match(pattern, i)
        piece = escape.group() if escape else pattern[i]
        i += len(piece)
        if piece in ("\\s", "\\S") or piece.startswith("\\p"):
            if inside and piece == "\\S":
                return None
            matched = "".join(f"\\x{c:02x}" for c in range(128) if regex.match(r"\s" if piece == _NO_SPACE else piece, chr(c)))
            out.append(matched if inside else f"[{'^' if piece == _NO_SPACE else ''}{matched}]")
            continue
        if escape and piece[1].isalpha():
            return None
        inside = piece == "[" or (inside and piece != "]")
        out.append(piece)
    try:
        re.compile("".join(out))
    except re.error:
        return None
    return "".join(out)


_ESCAPE = re.compile(r"\\(?:p\{\w+\}|.)", re.S)
_NO_SPACE = "\\S"


class Encoder:
    """Encodes texts with a serialised model; remembers the ids of pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor()
        self._processor.LoadFromSerializedProto(model)
        self._split = regex.compile(pattern).findall
        ascii_only = ascii_pattern(pattern)
        self._split_ascii = re.compile(ascii_only).findall if ascii_only else self._split
        self._symbols = str.maketrans({chr(b): symbol for b, symbol in enumerate(byte_symbols())})
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        # By number: how many ids, where they begin, and all ids one behind the other.
        self._sizes = self._firsts = np.zeros(0, np.int64)
        self._values = np.zeros(0, np.int32)

    def _encode(self, pretokens: list[str]) -> list[list[int]]:
        mapped = [p.encode().decode("latin-1").translate(self._symbols) for p in pretokens]
        return self._processor.Encode(mapped, num_threads=1)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """The numbers of all pre-tokens of texts, and how many each text has."""
        if len(self._sizes) > MEMORY or len(self._values) > 16 * MEMORY:
            self._forget()
        split = [(self._split_ascii(text) if text.isascii() else self._split(text)) if text else () for text in texts]
        pretokens = list(chain.from_iterable(split))
        known = self._number
        numbers = list(map(known.get, pretokens))
        fresh = list(dict.fromkeys([p for p, n in zip(pretokens, numbers, strict=True) if n is None]))
        if fresh:
            known |= zip(fresh, range(len(self._sizes), len(self._sizes) + len(fresh)), strict=True)
            lists = self._encode(fresh)
            sizes = np.array(list(map(len, lists)), np.int64)
            self._firsts = np.concatenate([self._firsts, len(self._values) + np.cumsum(sizes) - sizes])
            self._sizes = np.concatenate([self._sizes, sizes])
            self._values = np.concatenate([self._values, np.array(list(chain.from_iterable(lists)), np.int32)])
            numbers = list(map(known.__getitem__, pretokens))
            for pretoken in fresh:
                if len(pretoken) > LONGEST_REMEMBERED:
                    del known[pretoken]
        return np.array(numbers, np.int64), list(map(len, split))

    def ids(self, text: str | None) -> list[int]:
        """The ids of one text; none for null and empty."""
        return self.batch_ids([text])[0].as_py()

    def batch_ids(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of texts as an Arrow array of lists."""
        numbers, amounts = self._numbers(texts)
        lengths = self._sizes[numbers]
        ends = np.cumsum(lengths)
        where = np.repeat(self._firsts[numbers] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        token_ends = np.concatenate([[0], ends])
        return pa.ListArray.from_arrays(pa.array(token_ends[np.cumsum([0, *amounts])].astype(np.int32)), pa.array(self._values[where]))


def decode(tokens: list[bytes], ids: list[int]) -> str:
    """The text of ids; byte sequences that are no characters become U+FFFD."""
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The Encoder of this Python worker for a broadcast (model, pattern)."""
    model, pattern, digest = shared.value
    key = digest, pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, pattern)
    return _ENCODERS[key]


def shared_model(df: DataFrame, path: str | None = None, pattern: str | None = None):
    """The model built from a vocabulary file on the driver, broadcast to the workers."""
    model = bpe_model(read_ranks(path or tokenizer_path()))
    return df.sparkSession.sparkContext.broadcast((model, pattern or pretoken_pattern(), hashlib.sha256(model).digest()))


def _slices(batch: pa.RecordBatch, column: int, characters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text."""
    begin = size = 0
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, length in enumerate(lengths):
        if i > begin and size + length > characters:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += length
    if begin < len(lengths):
        yield batch.slice(begin)


def encode_texts(documents: DataFrame, key: str, text: str, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of each row, without special tokens.

    Null and empty texts have the empty list of ids. Strings of special tokens are ordinary text.
    Repeated rows are encoded each. Other columns are ignored; an empty table gives no rows.
    ``path`` is the vocabulary file on the driver.
    """
    shared = shared_model(documents, path, pattern)
    key_type = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = worker_encoder(shared)
        for batch in batches:
            for part in _slices(batch, 1):
                ids = encoder.batch_ids(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    columns = documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text"))
    return columns.mapInArrow(work, f"key {key_type}, ids array<int>").withColumnRenamed("key", key)
