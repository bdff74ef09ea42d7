"""The search index of a chunk store, kept up to date by every ingest and opened by every retrieval.

The index holds the vectors of the store in cells around pivots, in parts. A refresh adds one part below
``index/parts``: the vectors of new document versions with their cell (a folder per cell), the document versions it
adds and takes away, a summary of each cell and the pivots of new cells. It reads the new versions only. Cells that
outgrow ``split_rows`` are divided: their vectors are dealt anew among pivots of their own and the old cell is closed.
A part counts once its line is in ``index/log``, a file that appears at once; a refresh that dies leaves nothing
that is read, and the next one does its work. Opening reads pivots and summaries; a search reads the cells that its
queries visit, without the versions that are gone.

Radii stay valid bounds when vectors go. The vectors nearest to a pivot, from which a search takes its first bound,
are named with their document version and left out when that is gone.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwire.operators.vectors import (
    BLOCK_ROWS, MAX_PIVOTS, SUMMARY, CellIndex, as_matrix, assign_cells, choose_pivots, pivot_rows, pivots_for, summarize_cells,
)
from groundwire.plans.workspace import scratch
from groundwire.sources.chunk_store import Store, if_there

SPLIT_ROWS = 65_536
VERSION = ["uri", "content"]
ROWS = "chunk_id string, uri string, content string, embedding array<float>, part int, pivot_distance double, cell int"


class _Parts:
    """The parts of an index that count, in order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        log = if_there(spark.read.parquet, f"{path}/index/log")
        lines = [] if log is None else log.orderBy("part").collect()  # one row per refresh
        self.folders = [f"{path}/index/parts/{row.folder}" for row in lines]
        self.closed = sorted({cell for row in lines for cell in row.closed})
        self.next = len(lines) + 1

    def read(self, kind: str, schema: str) -> DataFrame:
        """All rows of one kind; parts without such rows have no files of it."""
        held = [f"{f}/{kind}" for f in self.folders]
        found = None
        for folder in held:
            part = if_there(self.spark.read.schema(schema).parquet, folder)
            if part is not None:
                found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], schema) if found is None else found

    def rows(self) -> DataFrame:
        """Vectors of open cells whose document version is not gone."""
        return self.alive(self.read("rows", ROWS).filter(~F.col("cell").isin(self.closed)))

    def alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (uri, content, part, ...) without those that a later part took away."""
        gone = self.read("gone", "uri string, content string, part int").groupBy(*VERSION).agg(F.max("part").alias("_gone"))
        same = [rows[c] == gone[c] for c in VERSION]
        return rows.join(gone, [*same, rows["part"] < gone["_gone"]], "left_anti")

    def versions(self) -> DataFrame:
        return self.alive(self.read("versions", "uri string, content string, part int")).select(*VERSION).distinct()

    def pivots(self) -> np.ndarray:
        held = self.read("pivots", "cell int, pivot array<float>").orderBy("cell").toArrow()
        return as_matrix(held.column("pivot"))

    def summary(self) -> DataFrame:
        """One row per open cell and part."""
        whole = self.read("summary", f"{SUMMARY}, part int").filter(~F.col("cell").isin(self.closed))
        heads = whole.select("cell", "part", F.explode("nearest").alias("_h")).select("cell", "part", "_h.*")
        left = self.alive(heads).groupBy("cell", "part").agg(F.collect_list(F.struct("distance", *VERSION)).alias("nearest"))
        empty = F.array().cast("array<struct<distance:double,uri:string,content:string>>")
        return whole.drop("nearest").join(left, ["cell", "part"], "left").withColumn("nearest", F.coalesce("nearest", empty))


def open_index(spark: SparkSession, path: str, *, block_rows: int = BLOCK_ROWS) -> CellIndex | None:
    """The index of the store below ``path`` as its last refresh left it; None without one."""
    parts = _Parts(spark, path)
    if not parts.folders:
        return None
    return CellIndex(parts.rows(), parts.pivots(), parts.summary(), block_rows)


def refresh_index(spark: SparkSession, path: str, *, split_rows: int = SPLIT_ROWS) -> int:
    """Bring the index up to the store, whoever wrote to it; returns the number of parts. Compares document
    versions (never vectors or texts) and reads the vectors of new ones. The first refresh creates the index."""
    store, parts = Store(spark, path), _Parts(spark, path)
    if store.empty:
        return parts.next - 1
    current, known = store.versions().select(*VERSION), parts.versions()
    with scratch(current.join(known, VERSION, "left_anti"), "index-added") as added:
        with scratch(known.join(current, VERSION, "left_anti"), "index-gone") as gone:
            return _add_part(parts, store, added, gone, split_rows)


def has_index(spark: SparkSession, path: str) -> bool:
    return bool(_Parts(spark, path).folders)


def add_versions(spark: SparkSession, path: str, changed: DataFrame, *, split_rows: int = SPLIT_ROWS) -> int:
    """Take up what an ingest has just written: ``changed`` (uri, content, old_content). Nothing else is compared.
    Does nothing for a store without index."""
    parts = _Parts(spark, path)
    if not parts.folders:
        return 0
    gone = changed.filter("old_content IS NOT NULL").select("uri", F.col("old_content").alias("content"))
    return _add_part(parts, Store(spark, path), changed.select(*VERSION), gone, split_rows)


def _add_part(parts: _Parts, store: Store, added: DataFrame, gone: DataFrame, split_rows: int) -> int:
    spark, number = parts.spark, parts.next
    if parts.folders and not added.head(1) and not gone.head(1):
        return number - 1
    token = uuid.uuid4().hex
    folder = f"{parts.path}/index/parts/{token}"
    vectors = store.chunks().join(added, VERSION, "left_semi").select(
        "chunk_id", *VERSION, F.col("embedding").cast("array<float>").alias("embedding"), F.lit(number).alias("part")
    ).filter(F.col("embedding").isNotNull())
    if parts.folders:
        pivots, first = parts.pivots(), None
        _place(vectors, pivots, parts.closed, folder)
    else:
        with scratch(vectors, "index-vectors") as held:
            pivots, first = choose_pivots(held, pivots_for(held.count())), 0
            _place(held, pivots, parts.closed, folder)
    named = added.withColumn("part", F.lit(number))
    named.write.parquet(f"{folder}/versions")
    gone.withColumn("part", F.lit(number)).write.parquet(f"{folder}/gone")
    if first == 0 and len(pivots):
        pivot_rows(spark, pivots).coalesce(1).write.parquet(f"{folder}/pivots")
    _summarize(spark, folder, number)
    _log(spark, parts.path, number, token, [])
    return _split(_Parts(spark, parts.path), split_rows)


def _place(vectors: DataFrame, pivots: np.ndarray, closed: list[int], folder: str) -> None:
    """Write vectors to the open cell with the nearest pivot."""
    if len(pivots):
        open_cells = np.setdiff1d(np.arange(len(pivots)), closed)
        near = assign_cells(vectors, pivots[open_cells])
        cells = F.element_at(F.lit(open_cells.astype("int").tolist()).cast("array<int>"), F.col("cell") + 1)
        _write_rows(near.withColumn("cell", cells), folder)


def _write_rows(rows: DataFrame, folder: str) -> None:
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")


def _summarize(spark: SparkSession, folder: str, number: int) -> None:
    rows = if_there(spark.read.schema(ROWS).parquet, f"{folder}/rows")
    if rows is not None:
        summarize_cells(rows).withColumn("part", F.lit(number)).write.parquet(f"{folder}/summary")


def _log(spark: SparkSession, path: str, number: int, token: str, closed: list[int]) -> None:
    """The part counts from here on. Of two refreshes at a time one fails, and its part is never read."""
    line = spark.createDataFrame([(token, closed)], "folder string, closed array<int>")
    line.coalesce(1).write.parquet(f"{path}/index/log/part={number}")


def _split(parts: _Parts, split_rows: int) -> int:
    """Divide cells above ``split_rows`` vectors (twice the mean of MAX_PIVOTS cells, if that is more) in a part of
    its own. A cell whose vectors are all alike stays whole; its rows are dealt into blocks by a search."""
    spark = parts.spark
    sizes = {r.cell: r.n for r in parts.summary().groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    most = max(split_rows, -(-2 * sum(sizes.values()) // MAX_PIVOTS))
    large = {cell: -(-2 * n // most) for cell, n in sizes.items() if n > most}
    if not large:
        return parts.next - 1
    held = parts.rows().filter(F.col("cell").isin(sorted(large)))
    # as many pivots as halves of the limit, by hash; their sum is below twice MAX_PIVOTS
    wanted = spark.createDataFrame(sorted(large.items()), "cell int, k long")
    place = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(parts.next), "chunk_id"), "chunk_id")
    some = held.select("cell", "chunk_id", "embedding").join(wanted, "cell").withColumn("_at", F.row_number().over(place))
    some = some.filter(F.col("_at") <= 2 * MAX_PIVOTS).filter("_at <= k").select("cell", "embedding").toArrow()
    chosen, first, own = as_matrix(some.column("embedding")), len(parts.pivots()), {}
    cells = some.column("cell").to_numpy()
    pivots = []
    for cell in sorted(large):
        distinct = np.unique(chosen[cells == cell], axis=0)
        if len(distinct) > 1:
            own[cell] = (first + len(pivots), distinct)
            pivots.extend(distinct)
    if not own:
        return parts.next - 1
    token = uuid.uuid4().hex
    folder = f"{parts.path}/index/parts/{token}"
    dealt = None
    for cell, (start, near) in own.items():
        rows = held.filter(F.col("cell") == cell).drop("cell", "pivot_distance")
        part = assign_cells(rows, near).withColumn("cell", F.col("cell") + start)
        dealt = part if dealt is None else dealt.unionByName(part)
    _write_rows(dealt.withColumn("part", F.lit(parts.next)), folder)
    pivot_rows(spark, np.array(pivots), first).coalesce(1).write.parquet(f"{folder}/pivots")
    _summarize(spark, folder, parts.next)
    _log(spark, parts.path, parts.next, token, sorted(own))
    return parts.next
