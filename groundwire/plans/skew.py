"""Keeping tasks balanced around hot join keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[Column], *,
    how: str = "left", salts: int = 16,
) -> DataFrame:
    """Join a skewed ``left`` to a ``right`` that is small per key.

    Left rows of one key are spread over ``salts`` buckets by a hash of ``spread`` (columns that
    differ between those rows), and every right row is repeated once per bucket, so the result is
    the same and no task sees more than about 1/salts of a hot key.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


#: Keys that may be told apart as hot, and buckets of the hottest one. A key past the first bound holds less than a
#: thousandth of the rows.
MOST_HOT_KEYS, MOST_BUCKETS = 1000, 1024


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[Column], *,
    how: str = "left", bucket_rows: int = 20_000,
) -> DataFrame:
    """``salted_join`` for a ``right`` that is large as a whole: only rows of hot keys are repeated, each as often as
    its key needs buckets of about ``bucket_rows``, or a 1024th of the hottest key where that is more.

    Counts ``left`` by key first, in a job of its own, so read ``left`` from a table if it is dear to compute. The list
    of hot keys has at most a thousand rows, hence the broadcast.
    """
    spark = left.sparkSession
    counted = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_rows)
    hot = counted.orderBy(F.desc("_n"), *keys).limit(MOST_HOT_KEYS).collect()
    if not hot:
        return left.join(right, list(keys), how)
    rows_each = max(bucket_rows, hot[0]["_n"] / MOST_BUCKETS)
    named = [f"_hot_{k}" for k in keys]
    buckets = spark.createDataFrame(
        [(*(row[k] for k in keys), int(row["_n"] / rows_each) + 1) for row in hot],
        ", ".join(f"{n} {left.schema[k].dataType.simpleString()}" for n, k in zip(named, keys)) + ", _buckets int",
    )

    def with_buckets(side: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)])
        return side.join(F.broadcast(buckets), same, "left").drop(*named)

    dealt = with_buckets(left).withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_buckets")), F.lit(0)).cast("int")
    ).drop("_buckets")
    repeated = with_buckets(right).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_buckets"), F.lit(1)) - 1))
    ).drop("_buckets")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
