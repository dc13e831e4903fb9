"""Encoding of texts with a byte-level BPE vocabulary, through sentencepiece.

A sentencepiece BPE model is serialised straight from the vocabulary: a piece is
a token's bytes, each mapped to one printable character, its score the negative
rank, and normalisation is the identity. Texts are cut into pre-tokens by the
tokenizer's pattern, each is encoded by the model, and decoding maps the pieces'
characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: The pattern that cuts texts into pre-tokens (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids in a worker, and the longest one kept.
CACHE_SIZE, CACHE_CHARS = 200_000, 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


_CHARS = byte_characters()
_BYTES = {c: b for b, c in enumerate(_CHARS)}
_LATIN = {i: c for i, c in enumerate(_CHARS)}


def map_bytes(data: bytes) -> str:
    return data.decode("latin-1").translate(_LATIN)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: a varint, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ids, from a file of base64 tokens and ranks."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in lines}
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with the tokens as pieces 0..n-1 and <unk> after them."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, map_bytes(t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


def vocabulary_model(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    return serialise_model(read_ranks(f"{folder}/{name}.tiktoken"))


class Encoder:
    """Ids of texts, and texts of ids."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for a null or empty text."""
        if not text:
            return []
        parts = self.cut(text)
        known = self.known
        new = list({p for p in parts if p not in known})
        if new:
            ids = self.model.encode([map_bytes(p.encode("utf-8", "surrogatepass")) for p in new], out_type=int)
            if len(known) > CACHE_SIZE:
                known.clear()
                new, ids = self._all(parts)
            known.update(zip(new, ids))
        out = [i for p in parts for i in known[p]]
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out

    def _all(self, parts: list[str]) -> tuple[list[str], list[list[int]]]:
        new = list(set(parts))
        return new, self.model.encode([map_bytes(p.encode("utf-8", "surrogatepass")) for p in new], out_type=int)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the inverse of the mapping of bytes."""
        return bytes(_BYTES[c] for i in ids for c in self.model.id_to_piece(int(i))).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The encoder of a model, kept for the life of the Python worker."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; null and empty texts get an empty list.
    Whole texts are encoded; strings of special tokens are ordinary text. Only the
    two columns are read. The model (about 1 MB) is built once and broadcast."""
    model = df.sparkSession.sparkContext.broadcast(vocabulary_model(name, folder))

    def encode(batches):
        encoder = worker_encoder(model.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for row in ids for i in row), dtype=np.int32, count=int(ends[-1]))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens BIGINT) of every row; 0 for null and empty texts."""
    model = df.sparkSession.sparkContext.broadcast(vocabulary_model(name, folder))

    def count(batches):
        encoder = worker_encoder(model.value)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_tokens long")
