"""Languages of a text as a mixture, inferred from letter trigrams.

Training counts hashed trigrams per language over every training row; each task sends its sums, at most
languages x BUCKETS rows, and the smoothed table (4 bytes per language and bucket) is broadcast. For a
document, expectation-maximisation estimates the proportions of a set of languages. The set grows from the
likeliest single language by the one whose share would raise the likelihood most, as long as the gain beats
a penalty per language; only the bookkeeping is per document, all arithmetic runs over many texts at once.

Defined cases: null texts and texts without letters are ``und`` with score 0 and no mixture; the same holds
for all texts where there was nothing to learn from; ties go to the language first in code point order; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import give_back, packed, small_batches, unpacked

BITS = 15
BUCKETS = 1 << BITS
SLICE = 1_000_000
ROUNDS = 12
UNKNOWN = "und"
MIXTURE = "struct<lang_pred:string,score:double,mixture:array<struct<lang:string,share:double>>>"


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter, anything else counting as a blank, and their texts."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "u4")
    kept = np.where(letters[codes], codes, 0)
    middle = np.flatnonzero(kept)
    mixed = kept[middle - 1] * np.uint32(0x9E3779B1)
    mixed = (mixed ^ mixed >> np.uint32(15)) + kept[middle] * np.uint32(0x85EBCA6B)
    mixed = (mixed ^ mixed >> np.uint32(13)) * np.uint32(0xC2B2AE35) + kept[middle + 1] * np.uint32(0x27D4EB2F)
    mixed = (mixed ^ mixed >> np.uint32(16)) * np.uint32(0x165667B1)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return (mixed >> np.uint32(32 - BITS)).astype("i8"), np.searchsorted(ends, middle - 1, "right")


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for each in texts:
        held.append(each.as_py() or "")
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    chances: np.ndarray  # buckets x languages, each column sums to 1


def fit(rows: DataFrame, text: str, lang: str, smoothing: float = 0.05) -> Model:
    """Learn from every row whose ``lang`` is not null."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letters(), {}

        def told():
            for name, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(total[at])],
                    ["lang", "bucket", "n"],
                )

        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in set(names):
                own = batch.column("text").filter(pa.array(names == name))
                if name not in sums and len(sums) >= 64:
                    yield from told()
                    sums.clear()
                total = sums.setdefault(name, np.zeros(BUCKETS, "i8"))
                for texts in _slices(own):
                    total += np.bincount(trigrams(texts, letters)[0], minlength=BUCKETS)
        yield from told()
        sums.clear()
        give_back()

    small_batches(rows.sparkSession)
    known = rows.filter(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    counted = known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow().to_pydict()
    languages = tuple(sorted(set(table["lang"])))
    chances = np.full((BUCKETS, len(languages)), smoothing)
    if languages:
        column = {name: n for n, name in enumerate(languages)}
        chances[table["bucket"], [column[name] for name in table["lang"]]] += table["n"]
        chances /= chances.sum(axis=0)
    return Model(languages, chances)


def infer(texts: list[str], model: Model, letters: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions, texts x languages; rows of zeros for texts without letters."""
    found = np.zeros((len(texts), len(model.languages)))
    bucket, owner = trigrams(texts, letters)
    if not len(bucket) or not model.languages:
        return found
    seen, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, chance = seen // BUCKETS, model.chances[seen % BUCKETS]
    docs, begin = np.unique(owner, return_index=True)

    def per_text(values, starts):
        return np.add.reduceat(values, starts, axis=0)

    letters_in = per_text(n, begin)
    cost = penalty * np.log(letters_in + 1)
    single = per_text(n[:, None] * np.log(chance), begin)
    best = single.argmax(axis=1)
    shares = np.zeros((len(docs), len(model.languages)))
    shares[np.arange(len(docs)), best] = 1
    fitness = single.max(axis=1)
    open_ = np.arange(len(docs))
    sizes = np.diff(np.append(begin, len(seen)))
    while len(open_) and len(model.languages) > 1:
        rows = np.flatnonzero(np.repeat(np.isin(np.arange(len(docs)), open_), sizes))
        own, weight = chance[rows], n[rows]
        length = sizes[open_]
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])

        def mix(part):
            return np.einsum("ij,ij->i", np.repeat(part, length, axis=0), own)

        part = shares[open_]
        gain = per_text(own * (weight / mix(part))[:, None], starts) / letters_in[open_, None] - 1
        gain[part > 0] = -1
        extra, rise = gain.argmax(axis=1), gain.max(axis=1)
        worth = rise * letters_in[open_] > cost[open_]  # by concavity the gain is no larger than this
        if not worth.any():
            break
        keep = np.repeat(worth, length)
        own, weight, part, extra, open_ = own[keep], weight[keep], part[worth] * 0.8, extra[worth], open_[worth]
        length = sizes[open_]
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        part[np.arange(len(open_)), extra] = 0.2
        for _ in range(ROUNDS):
            part = part * per_text(own * (weight / mix(part))[:, None], starts) / letters_in[open_, None]
        reached = per_text(weight * np.log(mix(part)), starts)
        better = reached - fitness[open_] > cost[open_]
        open_ = open_[better]
        shares[open_], fitness[open_] = part[better], reached[better]
    found[docs] = shares / shares.sum(axis=1, keepdims=True)
    return found


def predict(df: DataFrame, text: str, model: Model, penalty: float = 2.0) -> DataFrame:
    """Add lang_pred, score (the share of that language) and mixture (languages and shares, largest first)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(MIXTURE)
    def mixture(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, known = _letters(), shared.value
        inner = pa.struct([("lang", pa.string()), ("share", pa.float64())])
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.list_(inner))])
        for batch in batches:
            rows = []
            for texts in _slices(batch):
                for shares in infer(texts, known, letters, penalty).tolist():
                    order = sorted((-s, n) for n, s in enumerate(shares) if s > 0)
                    parts = [{"lang": known.languages[n], "share": -s} for s, n in order]
                    top = parts[0] if parts else {"lang": UNKNOWN, "share": 0.0}
                    rows.append({"lang_pred": top["lang"], "score": min(1.0, top["share"]), "mixture": parts})
            yield pa.array(rows, kind)
        give_back()

    bound = packed(df, found=mixture(F.coalesce(F.col(text), F.lit(""))))
    return unpacked(bound, df.columns, **{n: F.col(f"found.{n}") for n in ("lang_pred", "score", "mixture")})


def held_out(doc_id: str, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
