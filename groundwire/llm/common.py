"""Pieces several of the operators share: ASCII words, row keys, running totals, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwire.functions.text import compute_once
from groundwire.plans.workspace import materialize

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_words(text: Column) -> Column:
    """Runs of characters other than blanks and ASCII controls 9-13; null and blank texts give none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def with_shingles(df: DataFrame, text: Column, size: int, name: str) -> DataFrame:
    """Add ``name``: 64-bit hashes of the runs of ``size`` words; one hash of the whole sequence for
    shorter texts, an empty array for texts without words. Repeats are kept."""
    hashed = compute_once(df, {"_words": F.transform(ascii_words(text), lambda w: F.xxhash64(w))})
    n = F.size("_words")
    runs = F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(size)]),
    )
    whole = F.array(F.xxhash64("_words", n))
    shingles = F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, whole).otherwise(runs)
    return compute_once(hashed, {name: shingles}).drop("_words")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what Python tasks receive at once, so that long texts do not add up: a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return memory a task has freed to the machine; its worker process stays for the next tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return by hand
        pass


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """The caller's columns as one struct ``row``, beside the columns an operator works with, so that no name of
    the caller's can clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[column.alias(name) for name, column in own.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The caller's ``columns`` again, ``new`` ones replacing those of the same name or following them."""
    kept = [new.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *[column.alias(name) for name, column in new.items() if name not in columns])


def spread(df: DataFrame) -> int:
    """Partitions for an explicit deal: the session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and including this one in ``order``.

    Range partitions are written once to the shared folder with their numbers, so every later read
    agrees on them. Each adds the totals of those before it (one row per partition) to its own window.
    """
    dealt = df.repartitionByRange(spread(df), *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "running-total")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select(
        "_part",
        F.coalesce(F.sum("_total").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"),
    )
    own = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        dealt.join(before, "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row.n, row.s


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected ``edges``: columns node and component (its smallest node).

    Alternating large and small stars: every step is a minimum per node with partial sums and a join,
    so a hub of any degree is never gathered in one place; stops when the edge set no longer changes.
    Nodes without an edge to another node are not returned. Each step is a written table.
    """
    current = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links"
    )
    seen = _signature(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(low, large.a == low.n)
        small = joined.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
        current = materialize(small.filter("a <> b").distinct(), "links")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
