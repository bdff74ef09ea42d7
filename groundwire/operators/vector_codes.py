"""Approximate search on coded vectors, ranked again on the full ones.

A vector is cut into ``parts`` pieces, and each piece is replaced by the number of the nearest of up to 256 centres of
its own, so a vector of 64 floats becomes 16 bytes. The centres come from k-means over a sample of at most
TRAIN_ROWS vectors; every vector is coded. A search reads the codes of the cells that the queries visit, takes the
``rerank`` nearest codes for each query, and reads the full vectors of those alone for the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from groundwire.operators import vectors as exact
from groundwire.operators.vectors import CellIndex, as_matrix
from groundwire.plans.workspace import materialize

TRAIN_ROWS, ROUNDS, CENTRES = 65_536, 8, 256


def _centres(rows: np.ndarray) -> np.ndarray:
    """Up to CENTRES centres of the rows, by k-means from spread-out distinct rows."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= CENTRES:
        return distinct
    centres = distinct[np.linspace(0, len(distinct) - 1, CENTRES).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(rows, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros(centres.shape)
        np.add.at(sums, nearest, rows)
        centres[counts > 0] = (sums[counts > 0] / counts[counts > 0, None]).astype(np.float32)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)


@dataclass
class CodeBook:
    """The centres of each piece of a vector, and where the pieces begin and end."""

    centres: list[np.ndarray]
    bounds: list[int]

    @classmethod
    def train(cls, stored: DataFrame, parts: int = 16) -> CodeBook:
        """From at most TRAIN_ROWS vectors of (chunk_id, embedding), picked by hash."""
        order = F.xxhash64(F.lit(3), F.col("chunk_id").cast("string"))
        rows = as_matrix(stored.orderBy(order, "chunk_id").limit(TRAIN_ROWS).toArrow().column("embedding"))
        bounds = np.linspace(0, rows.shape[1], min(parts, max(1, rows.shape[1])) + 1).astype(int).tolist()
        return cls([_centres(rows[:, a:b]) for a, b in zip(bounds, bounds[1:])], bounds)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.stack(
            [_nearest(rows[:, a:b], own) for own, a, b in zip(self.centres, self.bounds, self.bounds[1:])], axis=1
        ).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([own[codes[:, n]] for n, own in enumerate(self.centres)]).astype(np.float32)


@dataclass
class CodedIndex:
    """Cells of full vectors, the codes of their rows (chunk_id, code, cell), and the code book."""

    cells: CellIndex
    codes: DataFrame
    book: CodeBook


def build_codes(cells: CellIndex, path: str | None = None, *, parts: int = 16) -> CodedIndex:
    """Code all rows of an index; written below ``path``, or to the shared folder, in the cells of the index."""
    rows = cells.rows.select("chunk_id", "embedding", "cell")
    book = CodeBook.train(rows, parts)
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = [row.tobytes() for row in shared.value.encode(as_matrix(batch.column("embedding")))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), pa.array(codes, pa.binary()), batch.column("cell")], ["chunk_id", "code", "cell"]
                )

    kind = rows.schema["chunk_id"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"chunk_id {kind}, code binary, cell int")
    if path is None:
        return CodedIndex(cells, materialize(coded, "vector-codes"), book)
    coded.write.parquet(path)
    return CodedIndex(cells, rows.sparkSession.read.parquet(path), book)


def codes_for_recall(
    queries: DataFrame, cells: CellIndex, k: int = 5, *, rerank: int = 100, recall: float = 0.95, parts: int = 16
) -> CodedIndex:
    """``build_codes`` with as few parts as the wanted recall takes when ``rerank`` full vectors are read for a query:
    from ``parts`` on they are doubled, up to one for every number of a vector. The recall is measured against an exact
    search for PROBE_SAMPLE queries picked by hash, and has to lie above the wanted one by a third of what is
    missing to 1, since a sample may flatter."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(exact.PROBE_SAMPLE)
    some = materialize(some, "code-queries")
    true = materialize(exact.vector_topk(some, cells, k), "code-neighbours")
    width = cells.pivots.shape[1] if len(cells.pivots) else 1
    while True:
        index = build_codes(cells, parts=min(parts, width))
        measured = exact.recall_at_k(vector_topk_coded(some, index, k, rerank=rerank), true).first()
        if parts >= width or not measured.expected or measured.recall >= recall + (1 - recall) / 3:
            return index
        parts *= 2


def _candidates(asked: DataFrame, index: CodedIndex, probes: int | None, rerank: int) -> DataFrame:
    """(query_id, chunk_id): for each query the ``rerank`` rows with the nearest codes."""
    shared = asked.sparkSession.sparkContext.broadcast(index.book)

    def read(codes: pa.ChunkedArray) -> np.ndarray:
        packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8)
        return shared.value.decode(packed.reshape(len(codes), -1))

    codes = index.codes.withColumnRenamed("code", "vector")
    met = exact._join_loads(asked, index.cells, probes, codes, rerank, read, like_cells=False)
    place = exact.Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return met.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= rerank).select("query_id", "chunk_id")


@F.arrow_udf(DoubleType())
def _distance(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = as_matrix(left).astype(np.float64), as_matrix(right).astype(np.float64)
    return pa.array(np.sqrt(np.square(a - b).sum(axis=1)))


def vector_topk_coded(
    queries: DataFrame, index: CodedIndex, k: int = 5, *, rerank: int = 100, probes: int | None = None,
) -> DataFrame:
    """Approximate k nearest chunks per query, as ``vector_topk`` gives them: distances are those of the full vectors,
    of which ``rerank`` are read for a query. Without ``probes`` every cell that can hold a result is visited."""
    asked = exact._asked(queries, k)
    candidates = _candidates(asked.drop("k"), index, probes, rerank)
    full = index.cells.rows.select("chunk_id", F.col("embedding").alias("_stored"))
    measured = candidates.join(full, "chunk_id").join(asked, "query_id").select(
        "query_id", "chunk_id", "k", _distance("embedding", "_stored").alias("distance")
    )
    return exact._result(exact._rank(measured).filter(F.col("rank") <= F.col("k")))


def coded_recall(queries: DataFrame, index: CodedIndex, k: int = 5, *, rerank: int = 100, probes: int | None = None) -> DataFrame:
    """One row: the true neighbours, how many of them the coded search finds, and the share of all pairs of a query
    and a full vector that it reads."""
    found = vector_topk_coded(queries, index, k, rerank=rerank, probes=probes)
    recall = exact.recall_at_k(found, exact.vector_topk(queries, index.cells, k))
    stored = index.codes.agg(F.count("*").alias("_n"))
    return recall.withColumn("read_share", F.least(F.lit(1.0), F.lit(rerank) / F.lit(max(1, stored.first()[0]))))
