"""Hashed term counts of texts in Arrow batches, as Spark ML's ``HashingTF`` counts them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = r"[ \t\n\x0b\f\r]+"
SEED = 42
#: Bytes of the last, partial block of a term, by their number.
TAIL = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint32(bits) | x >> np.uint32(32 - bits)


def _mixed(block: np.ndarray) -> np.ndarray:
    return _turned(block * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def hash_terms(terms: pa.LargeStringArray) -> np.ndarray:
    """The signed 32-bit hash (Murmur3, x86, 32 bits) that ``HashingTF`` gives a term, for all terms at a time."""
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    held = terms.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and len(ends) else np.empty(0, np.uint8)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    # the block of four bytes that begins at each byte
    blocks = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    start, size = ends[:-1] - ends[0], np.diff(ends)
    found, at = np.full(len(terms), SEED, np.uint32), 0
    left = np.flatnonzero(size >= 4)
    while len(left):
        found[left] = _turned(found[left] ^ _mixed(blocks[start[left] + at]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at += 4
        left = left[size[left] >= at + 4]
    found ^= _mixed(blocks[start + (size & ~3)] & TAIL[size & 3]) ^ size.astype(np.uint32)
    found = (found ^ found >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    found = (found ^ found >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (found ^ found >> np.uint32(16)).view(np.int32)


def count_terms(texts: pa.Array, dim: int) -> np.ndarray:
    """A row of ``dim`` counts for each of ``texts``, none of which is null."""
    wide = texts.cast(pa.large_string())
    if pc.any(pc.match_substring_regex(wide, r"[\t\n\x0b\f\r]|  ")).as_py():
        wide = pc.replace_substring_regex(wide, BLANKS, " ")
    terms = pc.split_pattern(wide, " ")
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(wide)) * dim, lengths) + hash_terms(terms.flatten()) % dim
    return np.bincount(at, minlength=len(wide) * dim).reshape(-1, dim)
