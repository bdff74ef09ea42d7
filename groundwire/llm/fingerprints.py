"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every word shingle is hashed once; its top bits name a bin, the rest is its value, and a bin keeps its
smallest value. An empty bin copies a bin that holds something: it walks all bins in a full cycle of its own
and takes the first filled one. The low 8 bits of each bin are packed, eight bins to a long. The share of
equal bytes of two fingerprints, freed of the 1/256 that agree by chance, estimates the likeness of the sets.

All of it is column expressions; a text is dealt once.

Defined cases: null is the empty text; texts shorter than a shingle are one shingle; texts without words have
the empty fingerprint, whose likeness is 1 to another empty one and 0 to any other; an empty table gives no
rows; texts that share a doc_id follow each other in the order of a hash; rows equal in doc_id and text are one
document, whose copies all come out; the only document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwire.functions.text import compute_once
from groundwire.llm.common import spread, with_shingles
from groundwire.plans.workspace import materialize

#: Bins, a power of two and a multiple of 8; words of a shingle.
BINS, WORDS = 256, 5
BIN_BITS = BINS.bit_length() - 1
VALUE_BITS = 63 - BIN_BITS
EMPTY = (1 << VALUE_BITS) - 1
STEP_FACTOR, TRIES = 40_503, 16
NO_ID = -(1 << 63)


def _dense_bins(df: DataFrame, shingles: str) -> DataFrame:
    """Add ``_bins``: for each bin in order, bin * 2^VALUE_BITS + its smallest value, EMPTY where there is none."""
    keyed = F.transform(shingles, lambda h: F.when(h.bitwiseAND(EMPTY) == EMPTY, h.bitwiseAND((1 << 63) - 2))
                        .otherwise(h.bitwiseAND((1 << 63) - 1)))
    blanks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), VALUE_BITS) + EMPTY)
    ordered = compute_once(df, {"_ordered": F.sort_array(F.concat(keyed, blanks))})

    def leads(x: Column, i: Column) -> Column:
        return (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get("_ordered", i - 1), VALUE_BITS))

    return compute_once(ordered, {"_bins": F.filter("_ordered", leads)}).drop("_ordered")


def _densified(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the low 8 bits of every bin, empty ones borrowed; empty where no bin is filled.

    Bin b walks b + step, b + 2 step, ... mod BINS with an odd step of its own, a full cycle since BINS is a power
    of two, and takes the first filled bin. The first TRIES steps are looked at one after the other; where they
    all fail, few bins are filled, and each of those tells when the walk would meet it: t = (j - b) / step.
    """
    inverse = F.array(*[F.lit(pow(_step_of(b), -1, BINS)) for b in range(BINS)])
    filled = compute_once(df, {"_filled": F.filter("_bins", _is_filled)})

    def borrowed(b: Column) -> Column:
        step = F.shiftright(b * STEP_FACTOR, 8).bitwiseAND(BINS - 1).bitwiseOR(1)
        tried = [F.get("_bins", (b + step * t).bitwiseAND(BINS - 1)) for t in range(1, TRIES + 1)]

        def turn(x: Column) -> Column:
            at = F.shiftright(x, VALUE_BITS).cast("int")
            return ((at - b) * F.get(inverse, b)).bitwiseAND(BINS - 1) * 256 + x.bitwiseAND(255).cast("int")

        last = F.array_min(F.transform("_filled", turn)).bitwiseAND(255)
        return F.coalesce(*[F.when(_is_filled(x), x.bitwiseAND(255).cast("int")) for x in tried], last)

    low = F.transform("_bins", lambda x, b: F.when(_is_filled(x), x.bitwiseAND(255).cast("int")).otherwise(borrowed(b)))
    none = F.array().cast("array<tinyint>")
    signed = F.transform(low, lambda x: (x - 128).cast("tinyint"))
    return compute_once(filled, {name: F.when(F.size("_filled") == 0, none).otherwise(signed)}).drop("_bins", "_filled")


def _is_filled(x: Column) -> Column:
    return x.bitwiseAND(EMPTY) != EMPTY


def _step_of(b: int) -> int:
    return (b * STEP_FACTOR >> 8) & (BINS - 1) | 1


def with_fingerprint(df: DataFrame, text: Column, name: str, words: int = WORDS) -> DataFrame:
    """Add ``name``: one byte per bin; empty for texts without words."""
    return _densified(_dense_bins(with_shingles(df, text, words, "_shingles"), "_shingles").drop("_shingles"), name)


def as_hex(fingerprint: str) -> Column:
    digits = F.array(*[F.lit(f"{n:02x}") for n in range(256)])
    return F.array_join(F.transform(fingerprint, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a: str, b: str) -> Column:
    """The bias-corrected share of equal bytes, between 0 and 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    corrected = F.greatest((equal / BINS - 1 / 256) / (1 - 1 / 256), F.lit(0.0))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def with_next(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``next``: the ``order`` columns of the next distinct row, of the first for the last.

    Range partitions are written once with their numbers and look ahead within themselves; one row per
    partition tells where the following one begins.
    """
    dealt = rows.distinct().repartitionByRange(spread(rows), *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "in-order")
    ahead = dealt.withColumn("_next", F.lead(F.struct(*order)).over(W.partitionBy("_part").orderBy(*order)))
    starts = dealt.groupBy("_part").agg(F.min(F.struct(*order)).alias("_start"))
    parts = W.orderBy("_part")
    follows = starts.select(
        "_part", F.coalesce(F.lead("_start").over(parts), F.min("_start").over(W.partitionBy(F.lit(0)))).alias("_follow")
    )
    joined = ahead.join(follows, "_part")
    return joined.withColumn("next", F.coalesce("_next", "_follow")).drop("_part", "_next", "_follow")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Columns doc_id, n_chars, fingerprint, edited, next_fingerprint, edited_fingerprint, one row per document.

    The edited text: the last floor(n_chars / 2) code points replaced by as many, or all, of the first of the
    next document's. Who follows whom is found on ids alone. Each text is then dealt once, by its own id, and
    sends the part the one before it needs, with its fingerprint.
    """
    # no id sorts first, as nulls do, and is told apart from the smallest id by its text
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    own = docs.select(key.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    order = with_next(own.select("id", "mark", F.length("text").alias("n")), ["id", "mark"])
    before = order.select(
        F.col("next.id").alias("id"), F.col("next.mark").alias("mark"), F.col("id").alias("to_id"),
        F.col("mark").alias("to_mark"), F.col("n").alias("to_n"),
    )
    marked = with_fingerprint(own, F.col("text"), "fingerprint", words)
    gifts = marked.join(before, ["id", "mark"]).select(
        F.col("to_id").alias("id"), F.col("to_mark").alias("mark"),
        F.substring("text", F.lit(1), F.floor(F.col("to_n") / 2).cast("int")).alias("gift"),
        F.col("fingerprint").alias("next_fingerprint"),
    ).groupBy("id", "mark").agg(F.first("gift").alias("gift"), F.first("next_fingerprint").alias("next_fingerprint"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("gift"))
    bound = compute_once(marked.join(gifts, ["id", "mark"]), {"edited": edited}).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "fingerprint", "edited",
        "next_fingerprint",
    )
    return with_fingerprint(bound, F.col("edited"), "edited_fingerprint", words)
