"""Repeated lines across documents, kept only in the smallest document that holds them.

Line hashes are range-partitioned with documents and positions as secondary keys, so a line in a third of
all documents still spans many partitions. Each partition is streamed in order: the first document of a
hash owns it, rows of other documents are lost. Only the rows that open a partition may have their owner
in an earlier one; they are settled against one summary row per partition. What comes out are compressed
bitmaps, no text.

Defined cases: null text is one empty line; rows without doc_id keep all lines and take none from others;
rows that share a doc_id are one document, each with its own bitmap; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwire.llm.common import SPACES, ascii_lower, packed, small_batches, spread, unpacked
from groundwire.plans.workspace import materialize

KEY_BYTES = 16
LOST, OPENING, CLOSING = 0, 1, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition: what is lost, what opens the partition, and its last owner."""
    opening = last_key = None
    owner = 0

    def rows(kind, keys, docs, texts, places):
        n = len(docs)
        flat = pa.array([k.tobytes() for k in keys], pa.binary()) if kind != LOST else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, "int32")), flat, pa.array(docs), pa.array(texts), pa.array(places)],
            ["kind", "key", "doc", "text_key", "pos"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        held = batch.column("key")
        start = int(np.frombuffer(held.buffers()[1], "int32", 1, 4 * held.offset)[0])
        keys = np.frombuffer(held.buffers()[2], "u8", 2 * n, start).reshape(n, 2)
        docs, texts, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "text_key", "pos"))
        fresh = np.empty(n, bool)
        fresh[0] = last_key is None or bool((keys[0] != last_key).any())
        fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        owners = np.where(run >= 0, docs[run], owner)
        lost = docs != owners
        yield rows(LOST, None, docs[lost], texts[lost], places[lost])
        if opening is None:
            opening = keys[0].copy()
        first = ~lost & (keys == opening).all(axis=1)
        if first.any():
            yield rows(OPENING, keys[first], docs[first], texts[first], places[first])
        last_key, owner = keys[-1].copy(), int(owners[-1])
    if last_key is not None:
        yield rows(CLOSING, [last_key], np.array([owner]), np.array([0]), np.array([0], "int32"))


def lost_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row (doc, text_key, pos) for each line that an earlier document holds as well."""
    lines = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc"), _text_key(text).alias("text_key"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    long_enough = lines.filter(F.length(F.btrim("line", F.lit(SPACES))) >= min_chars)
    keyed = long_enough.select(
        F.substring(F.unhex(F.sha2(line_key(F.col("line")), 256)), 1, KEY_BYTES).alias("key"), "doc", "text_key", "pos"
    )
    order = ["key", "doc", "text_key", "pos"]
    dealt = keyed.repartitionByRange(spread(docs), *order).sortWithinPartitions(*order)
    settled = materialize(
        dealt.mapInArrow(_settle, "kind int, key binary, doc long, text_key long, pos int"), "lines"
    )
    owners = settled.filter(F.col("kind") == CLOSING).groupBy("key").agg(F.min("doc").alias("owner"))
    opening = settled.filter(F.col("kind") == OPENING).join(owners, "key").filter(F.col("doc") > F.col("owner"))
    columns = ["doc", "text_key", "pos"]
    return settled.filter(F.col("kind") == LOST).select(columns).unionByName(opening.select(columns))


@F.arrow_udf(T.BinaryType())
def _pack(places: pa.Array) -> pa.Array:
    out = []
    for each in places:
        lost = np.asarray(each.as_py())
        keep = np.ones(lost.max() // 8 * 8 + 8, bool)
        keep[lost] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.array(out, pa.binary())


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """Columns doc, text_key, n_dropped, keep_bitmap of the documents that lose a line.

    A line is known by its trimmed, lower-cased form of ``min_chars`` or more characters. A bitmap is a
    deflated string of bits, first line first, 1 for a line that stays; lines beyond its end stay.
    """
    lost = lost_lines(docs, doc_id, text, min_chars)
    grouped = lost.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("places"))
    return grouped.select(
        "doc", "text_key", F.size("places").cast("long").alias("n_dropped"), _pack("places").alias("keep_bitmap")
    )


@F.arrow_udf(T.StringType())
def _keep(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    out = []
    for text, bitmap in zip(texts, bitmaps):
        if bitmap.is_valid:
            lines = (text.as_py() or "").split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), "u1"))[: len(lines)].tolist()
            keep += [1] * (len(lines) - len(keep))
            text = pa.scalar("\n".join(line for line, stays in zip(lines, keep) if stays))
        out.append(text.as_py())
    return pa.array(out, pa.string())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines the bitmaps keep in ``text`` (null stays null), and n_lines and n_dropped."""
    small_batches(docs.sparkSession)
    own = packed(docs, doc=F.col(doc_id).cast("long"), text_key=_text_key(text))
    # rows without doc_id find no bitmap
    joined = own.join(bitmaps, ["doc", "text_key"], "left")
    whole = F.col("row").getField(text)
    n_lines = F.length(F.regexp_replace(F.coalesce(whole, F.lit("")), "[^\n]+", "")) + 1
    return unpacked(joined, docs.columns, **{
        text: _keep(whole, F.col("keep_bitmap")), "n_lines": n_lines.cast("long"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
    })
