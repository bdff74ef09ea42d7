"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, followed by the same order again for
each further pass. A copy finishes when its source has sent as many words as the queue holds up to and
including it; divided by the source's target this is its virtual finish time. All copies of all sources,
sorted by that time, are sent until the budget is spent.

Targets: weighted shares of the budget; a source stops at ``passes`` times its own size and its excess is
shared by weight among the rest, again and again until none is above.

Defined cases: null text has size 0, null sources are one source of their own, rows equal in doc_id, source
and text share one decision, documents of size 0 are never taken, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import WORD_CLASS, packed, running_total, unpacked
from groundwire.plans.workspace import materialize


def _units(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_CLASS)).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        _place(doc_id, text, source).alias("place"),
    )


def _place(doc_id: str, text: str, source: str) -> Column:
    """The shuffled place of a document within its source."""
    return F.xxhash64(F.lit(20), F.col(doc_id), F.col(source), F.xxhash64(F.col(text)))


def targets(sources: DataFrame, weights: Sequence[float], budget: float, passes: int) -> DataFrame:
    """Add ``target`` to rows (source, source_size, rank). The level, target per unit of weight, only rises
    as sources fill up, so each round (one sum over the sources) fixes at least one of them or ends."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int")))
    cap = F.col("source_size") * float(passes)
    level = 0.0
    while True:
        full = F.col("weight") * level >= cap
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        risen = (budget - sums.spent) / sums.open if sums.open else level
        if risen <= level:
            break
        level = risen
    return weighed.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight", "rank")


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2,
) -> DataFrame:
    """Columns doc_id, source, size, place, source_size, target, copies, taken: one row per document.

    ``weights`` repeat over the sources in code point order, nulls last; ``share`` is the budget as a part
    of all words; no document is taken more than ``passes`` times.
    """
    order = [F.col("source").asc_nulls_last(), F.col("place").asc(), F.col("doc_id").asc()]
    rows = _units(docs, doc_id, text, source)
    units = rows.groupBy("doc_id", "source", "place").agg(F.sum("size").alias("mass"))
    queued = materialize(running_total(units, order, "mass", "upto"), "queues")

    by_source = materialize(queued.groupBy("source").agg(
        F.sum("mass").alias("source_size"), F.min(F.col("upto") - F.col("mass")).alias("start"), F.lit(1).alias("one"),
    ), "sources")
    ranked = running_total(by_source, [F.col("source").asc_nulls_last()], "one", "rank").drop("one")
    total = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    goals = materialize(targets(ranked, weights, share * total, passes), "targets")

    same = queued["source"].eqNullSafe(goals["source"])
    timed = queued.join(goals, same).drop(goals["source"]).withColumn("sent", F.col("upto") - F.col("start"))

    def finish(copy: Column) -> Column:
        return (F.col("sent") + (copy - 1) * F.col("source_size")) / F.col("target")

    copies = timed.filter((F.col("mass") > 0) & (F.col("target") > 0)).select(
        F.col("place"), F.col("mass"), F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("copy"),
        "sent", "source_size", "target",
    ).select(finish(F.col("copy")).alias("finish"), "place", "copy", "mass")
    sent = running_total(copies, [F.col("finish"), F.col("place"), F.col("copy")], "mass", "total")
    last = sent.filter(F.col("total") <= share * total).agg(F.max(F.struct("finish", "place", "copy")).alias("last")).first()["last"]

    def is_sent(copy: int) -> Column:
        if last is None:
            return F.lit(0)
        when, own = finish(F.lit(copy)), F.col("place")
        same_time = when == last.finish
        before = (when < last.finish) | (same_time & (own < last.place)) | (
            same_time & (own == last.place) & (F.lit(copy) <= last.copy)
        )
        return F.when((F.col("mass") > 0) & (F.col("target") > 0) & before, 1).otherwise(0)

    decided = timed.select(
        F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "source_size", "target",
        sum((is_sent(n) for n in range(1, passes + 1)), F.lit(0)).alias("copies"),
    )
    found = rows.join(decided, (F.col("place") == F.col("_place")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.drop("_id", "_place").withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, each document as many times as the mix takes it."""
    names = [options.get(k, k) for k in ("doc_id", "text", "source")]
    taken = mix(docs, **options).filter("copies > 0").select(
        F.col("doc_id").alias("taken_id"), "place", "copies"
    ).distinct()
    own = packed(docs, own_id=F.col(names[0]), own_place=_place(*names))
    same = (F.col("own_place") == F.col("place")) & F.col("own_id").eqNullSafe(F.col("taken_id"))
    repeated = own.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(repeated, docs.columns)
