"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary itself.

No tokenizer is trained. Each token of the rank file becomes one piece of a sentencepiece BPE model, written
here as the serialised protocol buffer: the token's bytes mapped one to one to printable characters, scored by
the negative rank, so that the best merge is the one of lowest rank; the normaliser is the identity. A text
is cut into pre-tokens by the tokenizer's pattern, each encoded on its own; decoding maps the pieces of the
ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import own_name, slices, whole_text

#: Pre-tokens that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 100_000
#: Longer pre-tokens are not remembered.
SHORT = 64
NORMAL, UNKNOWN = 1, 2  # fixed values: piece types of the sentencepiece format
BPE = 2  # fixed value: model type of the sentencepiece format


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; a token's id is its rank, the unknown piece comes last.

    Ranks must be 0 to n - 1 and hold all single bytes.
    """
    shown = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n - 1")
    pieces = [
        _field(1, _field(1, "".join(shown[b] for b in token)) + _field(2, -float(rank)) + _field(3, NORMAL))
        for rank, token in enumerate(tokens)
    ]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(2, _field(3, BPE) + _field(40, len(tokens)))
    normaliser = _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normaliser


class _Remembered(dict):
    """The ids of pre-tokens as 32-bit integers, encoded when first met."""

    def __init__(self, encode_word):
        super().__init__()
        self.encode_word = encode_word

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode_word(word), np.int32).tobytes()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes as the tiktoken library does with the same ranks and pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        shown = byte_characters()
        self.shown = dict(enumerate(shown))  # for str.translate of latin-1 text
        back = {c: b for b, c in enumerate(shown)}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.known = _Remembered(self.encode_word)

    def encode_word(self, word: str) -> list[int]:
        """The ids of a pre-token. One that is itself a token is that token, whatever the merges say."""
        data = word.encode("utf-8", "surrogatepass")
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        return self.model.encode(data.decode("latin-1").translate(self.shown))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pattern.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path, pattern)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.empty(0, np.int32))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the array column `ids` (replaced where docs has one) of the token ids of each whole text.

    Null and empty texts have no ids. Rows are independent: repeated rows, ties and other columns, null or not,
    pass through as they are; an empty table stays empty. The vocabulary's path must exist on all executors.
    """

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in slices(batches):
            yield _lists([own.encode(x.as_py()) for x in batch])

    return docs.withColumn(ids, ids_of(whole_text(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """encoded with the binary column `text` of the bytes that the ids stand for; null ids give no bytes."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in slices(batches):
            yield pa.array([own.decode(x.values.to_numpy()) for x in batch], pa.binary())

    return encoded.withColumn(text, bytes_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """docs with both columns of `encode` and `decode`, the ids decoded by the worker that made them.

    Cases are as in `encode`; the decoded bytes of a null text are empty.
    """

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in slices(batches):
            found = [own.encode(x.as_py()) for x in batch]
            back = pa.array([own.decode(x) for x in found], pa.binary())
            yield pa.StructArray.from_arrays([_lists(found), back], ["ids", "decoded"])

    coded = own_name(docs, "coded")
    marked = docs.withColumn(coded, both(whole_text(text)))
    return marked.withColumns({ids: F.col(f"{coded}.ids"), decoded: F.col(f"{coded}.decoded")}).drop(coded)
