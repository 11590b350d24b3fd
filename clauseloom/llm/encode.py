"""Encoding of documents with a public byte-level BPE vocabulary.

The rank file of the vocabulary is serialised as a sentencepiece BPE model: each
token's bytes become printable letters (one per byte), its score is its negative
rank, the normaliser is the identity.  Merging by highest score is then merging by
lowest rank, so the model gives the vocabulary's ids once the text has been parted
into pre-tokens.  The model is built from the file given; nothing is trained.

Defined cases: null, empty text -> empty list; blank text is encoded as it stands;
repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that parts text into pre-tokens, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a worker before it starts afresh.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """A printable letter for each byte; bytes without one of their own get the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def piece_model(tokens: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; piece i+1 is the token of rank i, piece 0 the unknown."""
    letters = byte_letters()
    ranked = sorted(tokens.items(), key=lambda x: x[1])
    if [rank for _, rank in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    pieces = [_message(1, _message(1, b"unknown piece") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for token, rank in ranked:
        name = "".join(letters[b] for b in token).encode()
        pieces.append(_message(1, _message(1, name) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    trainer = _number(3, 2) + _number(4, len(ranked) + 1) + _number(40, 0) + b"".join(
        _varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43)
    )
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes texts with a model of piece_model; one per Python worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.parts = regex.compile(PATTERN).findall
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        self.to_bytes = {letter: b for b, letter in enumerate(letters)}
        self.known: dict[str, bytes] = {}  #: the ids of a pre-token as int32, end to end
        self.length: dict[str, int] = {}

    def pre_tokens(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of each text, all of them known afterwards."""
        if len(self.known) > REMEMBERED:
            self.known, self.length = {}, {}
        parted = [self.parts(text) if text else [] for text in texts]
        new = list({*chain.from_iterable(parted)} - self.known.keys())
        if new:
            spelt = [part.encode().decode("latin-1").translate(self.to_letters) for part in new]
            for part, ids in zip(new, self.model.encode(spelt, num_threads=1)):
                self.known[part], self.length[part] = array("i", [i - 1 for i in ids]).tobytes(), len(ids)
        return parted

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        parted = self.pre_tokens(texts)
        known = self.known.__getitem__
        flat = [b"".join(map(known, parts)) for parts in parted]
        ends = pa.array([0, *accumulate(len(ids) // 4 for ids in flat)], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(flat))]))

    def sizes(self, texts: list[str | None]) -> pa.Array:
        parted = self.pre_tokens(texts)
        size = self.length.__getitem__
        return pa.array([sum(map(size, parts)) for parts in parted], pa.int32())

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.model.id_to_piece(int(i) + 1) for i in ids)
        return bytes(self.to_bytes[letter] for letter in pieces).decode()


def vocabulary_model(tokenizers: str = TOKENIZERS) -> bytes:
    return piece_model(read_ranks(os.path.join(tokenizers, VOCABULARY)))


def _mapped(df: DataFrame, id_col: str, text_col: str, out: str, tokenizers: str, what: str) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(vocabulary_model(tokenizers))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                result = getattr(encoder, what)(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), result], names=[id_col, out])

    kind = dict(df.dtypes)[id_col]
    shape = f"`{id_col}` {kind}, {out} " + ("array<int>" if what == "encode" else "int")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, shape)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """id, ids: the token ids of each row's text, without special tokens."""
    return _mapped(df, id_col, text_col, "ids", tokenizers, "encode")


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """id, size: the number of tokens of each row's text."""
    return _mapped(df, id_col, text_col, "size", tokenizers, "sizes")


def decode_column(ids, tokenizers: str = TOKENIZERS):
    """The texts of a column of id lists, by the inverse of the byte spelling; null for null."""
    model = vocabulary_model(tokenizers)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else encoder.decode(x))

    return decode(ids)
