"""Text expressions with Unicode whitespace, shared by routing, chunking and checks.

SQL ``trim`` strips blanks only and Java ``\\s`` is ASCII only, so the whitespace set is spelled out.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# The characters Unicode counts as whitespace for stripping and splitting.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RANGES = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_PATTERN = f"[^{WHITESPACE_RANGES}]+"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated words; splitting is several times faster than extracting matches."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"[{WHITESPACE_RANGES}]+")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when any needle is a substring; one byte scan per needle, stops at the first hit."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def starts_with_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(n) for n in needles])


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections on plain computed columns are merged into the expressions they use, so a
    rule set that mentions the lower-cased text thirty times would lower it thirty times. Nothing is
    merged across a generator: each column is evaluated once per row.
    """
    bound = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(bound)))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task counts at a time.
LETTER_BYTES = 262_144


def count_letters(texts: pa.Array) -> np.ndarray:
    """How often each of a to z occurs in each text: one pass over the bytes, of which no other character has these."""
    wide = texts.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    place = np.full(256, 31, np.int64)
    place[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(26)
    counts = np.zeros((len(wide), 32), np.int64)
    for start in range(int(ends[0]), int(ends[-1]), LETTER_BYTES):
        end = min(start + LETTER_BYTES, int(ends[-1]))
        low, high = np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, end, "left")
        sizes = np.minimum(ends[low + 1 : high + 1], end) - np.maximum(ends[low:high], start)
        keys = np.repeat(np.arange(high - low) * 32, sizes) + place[data[start:end]]
        counts[low:high] += np.bincount(keys, minlength=(high - low) * 32).reshape(-1, 32)
    return counts[:, :26]


@F.arrow_udf(ArrayType(DoubleType()))
def _letter_counts(texts: pa.Array) -> pa.Array:
    counts = count_letters(texts).astype(np.float64)
    return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * 26, pa.array(counts.ravel()))


def letter_embedder(rows: DataFrame) -> DataFrame:
    """A small embedder that SQL can repeat: how often each of a to z occurs, as a share of the largest count,
    rounded to six digits. A stand-in for an external model."""
    counted = rows.drop("embedding").withColumn("_counts", _letter_counts(F.lower(F.coalesce("text", F.lit("")))))
    top = F.greatest(F.array_max("_counts"), F.lit(1.0))
    shares = F.transform("_counts", lambda x: F.round(x / top, 6).cast("float"))
    return compute_once(counted, {"embedding": shares}).drop("_counts")
