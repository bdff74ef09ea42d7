"""Document quality: classifier evidence combined with what hosts and paths are like.

A logistic classifier on shape measures of the text gives each document its evidence, a log likelihood
ratio. Sites give the prior: good documents are counted per host and per path of a host (labels where there
are any, else the classifier's probability), a path's rate is shrunk towards its host's and a host's
towards the global rate. How strongly is estimated from the spread of the rates themselves, so sparse sites
say little. A document never counts towards its own prior.

Defined cases: null text is empty; null hosts and paths are sites of their own; several labels of one
document count as their mean; null labels are none; without labels of both kinds the evidence is 0 and
everything stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import give_back, packed, small_batches, unpacked
from groundwire.plans.workspace import materialize

#: The classifier is fitted on at most this many labelled documents, taken by a hash of their ids.
FIT_ROWS = 50_000
MEASURES = (
    "letters", "upper", "digits", "blanks", "breaks", "signs", "runs", "long_words", "length",
    "sign_words", "upper_words", "shouts", "bars", "repeats", "odd_lines", "odd_share",
)
SLICE = 500_000
_LETTER, _UPPER, _DIGIT, _BLANK, _BREAK, _SIGN = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """What each code point is."""
    kinds = np.full(0x110000, _SIGN, "u1")
    for code in range(0x30000):
        c = chr(code)
        if c.isalpha():
            kinds[code] = _LETTER | (_UPPER if c.isupper() else 0)
        elif c.isdigit():
            kinds[code] = _DIGIT
        elif c == "\n":
            kinds[code] = _BREAK
        elif c.isspace():
            kinds[code] = _BLANK
    return kinds


def measure(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """One row of MEASURES per text."""
    joined = "\n\n".join(texts) + "\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4")
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    kind = kinds[codes]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype("i8"), starts)

    def share(part, whole):
        return part / np.maximum(whole, 1)

    space = (kind & (_BLANK | _BREAK)) > 0
    sign, upper, letter = (kind & _SIGN) > 0, (kind & _UPPER) > 0, (kind & _LETTER) > 0
    begins = ~space & np.concatenate([[True], space[:-1]])
    word_at = np.flatnonzero(begins)
    n_words = per_text(begins)

    def per_word(flags):
        return np.add.reduceat(flags.astype("i8"), word_at) if len(word_at) else np.zeros(0, "i8")

    size, signs, caps, own = per_word(~space), per_word(sign), per_word(upper), per_word(letter)
    text_of = np.searchsorted(starts, word_at, "right") - 1

    def words_with(flags):
        return np.bincount(text_of, flags, minlength=len(texts))

    odd = (signs * 2 >= size) | (signs >= 2) | ((caps == own) & (own > 2))
    sums = np.add.reduceat(np.where(space, 0, codes.astype("i8") ** 2), word_at) if len(word_at) else size
    again = np.zeros(len(word_at), bool)
    again[1:] = (sums[1:] == sums[:-1]) & (size[1:] == size[:-1]) & (text_of[1:] == text_of[:-1])
    line_of = np.cumsum(kind == _BREAK)[word_at]
    lines, first, back = np.unique(line_of, return_index=True, return_inverse=True)
    line_odd = np.bincount(back, odd) * 2 >= np.bincount(back) if len(lines) else np.zeros(0, bool)
    line_text = text_of[first]
    n_lines = np.bincount(line_text, minlength=len(texts))
    n_letters, n_signs = per_text(letter), per_text(sign)
    repeat = np.concatenate([[False], codes[1:] == codes[:-1]]) & sign
    return np.column_stack([
        share(n_letters, lengths), share(per_text(upper), n_letters), share(per_text(kind == _DIGIT), lengths),
        share(per_text(kind == _BLANK), lengths), share(per_text(kind == _BREAK) - 2, lengths), share(n_signs, lengths),
        share(per_text(repeat), lengths), share(words_with(size > 20), n_words), np.log1p(n_words) / 10,
        share(words_with(signs >= 2), n_words), share(words_with((caps == own) & (own > 1)), n_words),
        share(per_text(codes == ord("!")), n_words), share(per_text(codes == ord("|")), n_words),
        share(words_with(again), n_words), share(np.bincount(line_text, line_odd, minlength=len(texts)), n_lines),
        share(words_with(odd), n_words),
    ])


def _measures():
    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = _classes()
        for texts in batches:
            rows, held, size = [], [], 0
            for each in [*texts, None]:
                if each is not None:
                    held.append(each.as_py())
                    size += len(held[-1])
                if held and (each is None or size >= SLICE):
                    rows.append(measure(held, kinds))
                    held, size = [], 0
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            bounds = np.arange(len(texts) + 1, dtype="i4") * len(MEASURES)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
        give_back()

    return measured


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _fitted(rows: DataFrame, fit_rows: int) -> tuple[list[float], float]:
    """Weights of the measures and the constant, such that the result is a log likelihood ratio."""
    labelled = rows.filter("label IS NOT NULL").select((F.col("label") >= 0.5).cast("double").alias("label"), "measures", "key")
    some = labelled.orderBy(F.xxhash64(F.lit(7), "key"), "key").limit(fit_rows)
    some = materialize(some.select("label", array_to_vector("measures").alias("features")), "fit-rows")
    good, n = some.agg(F.sum("label"), F.count("*")).first()
    if not n or good in (0, n):
        return [0.0] * len(MEASURES), 0.0
    model = LogisticRegression(regParam=1e-4, maxIter=60).fit(some)
    return [float(w) for w in model.coefficients], float(model.intercept) - float(np.log(good / (n - good)))


def _concentration(sites: DataFrame, rate: Column) -> float:
    """How many documents' worth of trust the level above deserves, from the spread of its sites' rates
    beyond what chance explains; between 1 and 10,000."""
    n, r = F.col("n"), F.col("good") / F.col("n")
    found = sites.filter(n >= 2).agg(
        F.sum(n * (r - rate) * (r - rate)).alias("spread"), F.sum(rate * (1 - rate)).alias("chance"),
        F.sum((n - 1) * rate * (1 - rate)).alias("room"),
    ).first()
    if not found.room or found.spread <= found.chance:
        return 10_000.0
    within = (found.spread - found.chance) / found.room  # the share of the variance that lies between sites
    return float(min(10_000.0, max(1.0, 1 / within - 1)))


def score(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str | Column = "source",
    path: str | Column = "lang", quality: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Columns doc_id, text_key, host, path, evidence, host_rate, path_rate, quality_score, kept: one row
    per row of ``docs``. ``labels`` has doc_id and 0 or 1 in ``quality``."""
    known = labels.filter(F.col(quality).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.avg(quality).alias("label")
    )
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
        (host if isinstance(host, Column) else F.col(host)).cast("string").alias("host"),
        (path if isinstance(path, Column) else F.col(path)).cast("string").alias("path"),
        _measures()(whole).alias("measures"),
    )
    rows = measured.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = materialize(rows.withColumn("key", F.xxhash64("doc_id", "text_key")), "measures")
    weights, constant = _fitted(rows, fit_rows)
    terms = [F.col("measures")[n] * w for n, w in enumerate(weights)]
    judged = rows.withColumn("evidence", reduce(lambda a, b: a + b, terms, F.lit(constant)))
    base = rows.agg(F.avg("label")).first()[0]
    base = 0.5 if base is None else base
    own = F.coalesce("label", _probability(F.col("evidence") + _logit(F.lit(float(base)))))
    judged = judged.select("doc_id", "text_key", "host", "path", "evidence", own.alias("own"))

    paths = materialize(
        judged.groupBy("host", "path").agg(F.sum("own").alias("good"), F.count("*").alias("n")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    everywhere = (total.good + 1) / (total.n + 2) if total.n else 0.5
    trust_host = _concentration(hosts, F.lit(everywhere))
    above = hosts.select(F.col("host").alias("_h"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    tree = paths.join(above, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    host_rate = (F.col("host_good") + trust_host * everywhere) / (F.col("host_n") + trust_host)
    trust_path = _concentration(tree, host_rate)

    sites = tree.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "good", "n", "host_good", "host_n")
    placed = judged.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    others_host = (F.col("host_good") - F.col("own") + trust_host * everywhere) / (F.col("host_n") - 1 + trust_host)
    others_path = (F.col("good") - F.col("own") + trust_path * F.col("host_rate")) / (F.col("n") - 1 + trust_path)
    rated = placed.withColumn("host_rate", others_host).withColumn("path_rate", others_path)
    scored = rated.withColumn("quality_score", _probability(F.col("evidence") + _logit(F.col("path_rate"))))
    return scored.select(
        "doc_id", "text_key", "host", "path", "evidence", "host_rate", "path_rate", "quality_score",
        (F.col("quality_score") >= threshold).alias("kept"),
    )


def without_rejected(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` the classifier does not reject."""
    judged = score(docs, labels, doc_id=doc_id, text=text, **options)
    lost = judged.filter("NOT kept").select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"))
    own = packed(docs, own_id=F.col(doc_id), own_key=F.xxhash64(F.col(text)))
    same = F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_key") == F.col("lost_key"))
    return unpacked(own.join(lost, same, "left_anti"), docs.columns)
