"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte becomes one character, each vocabulary entry one piece scored by its negative rank, and the
normaliser leaves everything alone; sentencepiece then merges the pair of lowest rank first, leftmost on
ties, which is what the rank file asks for. Every match of the split pattern is encoded on its own.
Nothing is trained and the vocabulary file is never copied: its bytes are read once and sent to the tasks.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import give_back, small_batches

#: Fixed value: the first of 256 letters that stand for the bytes 0 to 255.
FIRST_LETTER = 0x100
CACHE_CHARS = 3_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_SHIFT = {n: FIRST_LETTER + n for n in range(256)}


def letters_of(data: bytes) -> str:
    """One letter for each byte."""
    return data.decode("latin-1").translate(_SHIFT)


def _field(number: int, value: bytes | int) -> bytes:
    """One protocol-buffer field: a length-delimited one for bytes, a varint for whole numbers."""
    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def build_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece n is the token of rank n, an unknown piece ends the list."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([n]) not in ranks for n in range(256)):
        raise ValueError("ranks must count up from 0 and cover every byte")
    pieces = [
        _field(1, letters_of(t).encode()) + b"\x15" + struct.pack("<f", -float(n)) + _field(3, 1)
        for n, t in enumerate(tokens)
    ]
    pieces.append(_field(1, b"(unknown)") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = (
        _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
        + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b"(unknown)")
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class _Encoder:
    """Packed ids of pre-tokens, remembered within a task up to a bound on their characters."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import sentencepiece

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, vocabulary.splitlines()))}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(ranks))
        self.find = regex.compile(pattern).findall
        self.ranks, self.known, self.held = ranks, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; pre-tokens not seen before are encoded together."""
        split = [self.find(t) for t in texts]
        missing = set().union(*split).difference(self.known)
        size = sum(map(len, missing))
        if self.held and self.held + size > CACHE_CHARS:
            self.known, self.held = {}, 0
            missing = set().union(*split)
            size = sum(map(len, missing))
        if missing:
            self._learn(list(missing))
            self.held += size
        get = self.known.__getitem__
        return [b"".join(map(get, tokens)) for tokens in split]

    def _learn(self, missing: list[str]) -> None:
        raw = [t.encode() for t in missing]
        # a pre-token that is itself an entry is that entry, whatever its merges would give
        whole = [n for n, data in enumerate(raw) if data in self.ranks]
        merged = [n for n, data in enumerate(raw) if data not in self.ranks]
        found = self.model.encode([letters_of(raw[n]) for n in merged], num_threads=1)
        ids = [[self.ranks[raw[n]]] for n in whole] + found
        packed, at = array("I", chain.from_iterable(ids)), 0
        if sys.byteorder == "big":
            packed.byteswap()
        data = packed.tobytes()
        for n, own in zip(whole + merged, ids):
            end = at + 4 * len(own)
            self.known[missing[n]] = data[at:end]
            at = end


def _slices(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of a batch in lists of about ``chars`` characters."""
    held, size = [], 0
    for each in texts:
        held.append(each.as_py())
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    yield held


def _shared_vocabulary(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, text: str, vocabulary: str, pattern: str, name: str = "token_ids") -> DataFrame:
    """Add ``name``: the token ids of ``text`` as packed little-endian unsigned 32-bit integers.

    Null texts are empty and have no tokens; text that spells a special token is ordinary text; other
    columns pass through, and a column called ``name`` is replaced. ``vocabulary`` is the path of the
    rank file on the driver (about a megabyte), which is broadcast.
    """
    shared = _shared_vocabulary(df, vocabulary)

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(shared.value, pattern)
        for batch in batches:
            yield pa.array([ids for texts in _slices(batch) for ids in encoder.encode(texts)], pa.binary())
        encoder = None
        give_back()

    return df.withColumn(name, packed(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, token_ids: str, vocabulary: str, name: str = "decoded") -> DataFrame:
    """Add ``name``: the bytes that packed ``token_ids`` stand for; null ids give null."""
    shared = _shared_vocabulary(df, vocabulary)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lines = map(bytes.split, filter(bytes.strip, shared.value.splitlines()))
        entry = {int(r): base64.b64decode(t) for t, r in lines}
        for batch in batches:
            rows = (each.as_py() for each in batch)
            decoded = [None if x is None else b"".join(map(entry.__getitem__, array("I", x))) for x in rows]
            yield pa.array(decoded, pa.binary())
        entry = None
        give_back()

    return df.withColumn(name, bytes_of(F.col(token_ids)))


def n_tokens(token_ids: str) -> Column:
    return (F.octet_length(token_ids) / 4).cast("long")
