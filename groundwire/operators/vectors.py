"""Nearest neighbours by Euclidean distance: exact and cell-probing approximate.

The corpus is kept in cells around pivots, whose number grows with the root of its size; the cells are written
once, at ingest or for a single search, with a summary of each. A search goes twice. First every query meets one block
of each of its nearest cells, which gives a distance its k nearest cannot exceed. With that bound the triangle
inequality rules out cells that cannot hold a result, and the other cells travel together: neighbouring cells in one
load, neighbouring queries in another, and (load, query block) is an equi-join key. A query is sent once to a load, with
a bit for each cell of it that it visits, and a row to those query blocks only that visit its cell. Loads and query
blocks grow with the tables up to LOAD_ROWS, so up to that what is shuffled grows as the tables do. Each pair of them
emits at most k rows per query, all within its bound, never all pairs. The plan is the same for any number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwire.config import MAX_RETRIEVAL_RESULTS
from groundwire.plans.skew import spread_join
from groundwire.plans.workspace import materialize

BLOCK_ROWS = 8192
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
#: Most rows that a task holds of either side of a search, and the pairs of loads and query blocks that keep the
#: cores of a small cluster busy.
LOAD_ROWS, LEAST_PAIRS = 131_072, 64
#: Nearest cells of a query that give its first bound.
HOME_CELLS = 4
#: Queries that a task compares at a time.
SLICE_ROWS = 1024
#: Queries that ``choose_probes`` measures.
PROBE_SAMPLE = 256


def clamp_results(requested: Column, default: int = 5) -> Column:
    """Results per query: zero or null means the default, anything else is kept within 1..10."""
    wanted = F.coalesce(F.when(requested != 0, requested), F.lit(default))
    return F.greatest(F.lit(1), F.least(wanted, F.lit(MAX_RETRIEVAL_RESULTS))).cast("int")


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow list column to a dense matrix without per-row Python objects."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _square_norms(matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64)


def _pair_distances(queries: np.ndarray, rows: np.ndarray, q_at: np.ndarray, r_at: np.ndarray) -> np.ndarray:
    """Distances of the given pairs in double precision, a few megabytes at a time."""
    step = max(1, 1_000_000 // max(1, queries.shape[1]))
    distances = np.empty(len(q_at))
    for start in range(0, len(q_at), step):
        part = slice(start, start + step)
        gaps = queries[q_at[part]].astype(np.float64) - rows[r_at[part]]
        distances[part] = np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
    return distances


def closest(
    queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, ties: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(query position, row id, distance) of the k closest rows per query; ties go to the lower id, or to the lower
    of ``ties``, if given.

    A single-precision product finds candidates with a margin above its worst rounding error; final
    distances are computed directly in double precision, so equal vectors get equal distances.
    """
    if not len(queries) or not len(rows):
        return np.empty(0, np.int64), ids[:0], np.empty(0)
    row_norms, query_norms = _square_norms(rows), _square_norms(queries)
    rough = queries @ rows.T
    rough *= -2
    rough += row_norms.astype(np.float32)
    kth = min(k, len(rows)) - 1
    limit = np.partition(rough, kth, axis=1)[:, kth] if kth < len(rows) - 1 else rough.max(axis=1)
    unit = 2.0 * np.finfo(np.float32).eps
    largest = row_norms.max()
    margin = unit * (queries.shape[1] * np.sqrt(query_norms * largest) + largest + query_norms) + 1e-30
    q_at, r_at = np.nonzero(rough <= (limit + 2 * margin)[:, None])
    distances = _pair_distances(queries, rows, q_at, r_at)
    kept = _cut(q_at, (ids if ties is None else ties)[r_at], distances, k)
    return q_at[kept], ids[r_at[kept]], distances[kept]


def _in_slices(
    queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, ties: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """``closest`` over query slices, so the distance matrix stays within a few dozen megabytes."""
    step = max(1, 4_000_000 // max(1, len(rows)))
    parts = []
    for start in range(0, len(queries), step):
        q_at, found, distances = closest(queries[start:start + step], rows, ids, k, ties)
        parts.append((q_at + start, found, distances))
    return tuple(np.concatenate(column) for column in zip(*parts)) if parts else closest(queries, rows, ids, k)


def _within(queries: np.ndarray, rows: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query position, row position) of all pairs no farther apart than the query's ``limit``, and of a few that are
    by less than the error of a single-precision product."""
    row_norms, query_norms = _square_norms(rows), _square_norms(queries)
    left = np.hstack([queries, np.ones((len(queries), 1), np.float32)])
    right = np.hstack([rows * np.float32(-2), row_norms[:, None].astype(np.float32)])
    largest = row_norms.max()
    margin = 4 * np.finfo(np.float32).eps * (
        (queries.shape[1] + 2) * (2 * np.sqrt(query_norms * largest) + largest) + query_norms + np.square(limit)
    ) + 1e-30
    wanted = np.square(limit) - query_norms + margin
    flat = np.flatnonzero(left @ right.T <= wanted.astype(np.float32)[:, None])
    return np.divmod(flat, len(rows))


def _cut(q_at: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k closest per query, in the order of queries, distances and ids."""
    order = np.lexsort((ids, distances, q_at))
    sorted_q = q_at[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left") < k]


def _nearest_of_load(
    queries: np.ndarray, bound: np.ndarray, visits: np.ndarray, rows: np.ndarray, ids: np.ndarray, slots: np.ndarray,
    k: int, block_rows: int,
) -> tuple[np.ndarray, ...]:
    """(query position, row id, distance): for each query up to k of the closest rows of the cells it visits, none
    beyond its ``bound``. ``visits``: a column per cell of the load; ``slots``: the cell of each row."""
    order = np.argsort(slots, kind="stable")
    rows, ids, slots = rows[order], ids[order], slots[order]
    held, starts = np.unique(slots, return_index=True)
    ends = np.append(starts[1:], len(slots))
    pieces = [(c, a, min(a + block_rows, e)) for c, s, e in zip(held, starts, ends) for a in range(s, e, block_rows)]
    found = []
    for start in range(0, len(queries), SLICE_ROWS):
        asked, limit = queries[start:start + SLICE_ROWS], bound[start:start + SLICE_ROWS].astype(np.float64).copy()
        chosen = visits[start:start + SLICE_ROWS]
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        pending, waiting = [best], 0

        def settle(pending: list[tuple], asked: np.ndarray = asked, limit: np.ndarray = limit) -> tuple:
            q_at, r_at, distances = (np.concatenate(c) for c in zip(*pending))
            kept = _cut(q_at, ids[r_at], distances, k)
            q_at, r_at, distances = q_at[kept], r_at[kept], distances[kept]
            full = np.flatnonzero(np.bincount(q_at, minlength=len(asked)) >= k)
            last = np.searchsorted(q_at, full, side="left") + k - 1
            limit[full] = np.minimum(limit[full], distances[last])
            return q_at, r_at, distances

        for cell, a, e in pieces:
            at = np.flatnonzero(chosen[:, cell])
            if not len(at):
                continue
            open_ended = np.isinf(limit[at])
            sure, loose = at[~open_ended], at[open_ended]
            if len(sure):
                q_at, r_at = _within(asked[sure], rows[a:e], limit[sure])
                if len(q_at) > 16 * k * len(sure):  # a bound that keeps out little
                    loose = at
                elif len(q_at):
                    q_at, r_at = sure[q_at], r_at + a
                    pending.append((q_at, r_at, _pair_distances(asked, rows, q_at, r_at)))
                    waiting += len(q_at)
            if len(loose):
                q_at, r_at, distances = _in_slices(asked[loose], rows[a:e], np.arange(e - a), k, ids[a:e])
                pending.append((loose[q_at], r_at + a, distances))
                waiting += len(q_at)
            if waiting > 4 * k * len(asked):
                pending, waiting = [settle(pending)], 0
        q_at, r_at, distances = settle(pending)
        inside = distances <= bound[start:start + SLICE_ROWS][q_at]
        found.append((q_at[inside] + start, ids[r_at[inside]], distances[inside]))
    return tuple(np.concatenate(column) for column in zip(*found))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as a sortable array; text ids become a fixed-width type."""
    values = column.to_pandas().to_numpy()
    return values.astype(str) if values.dtype == object else values


def _rank(candidates: DataFrame) -> DataFrame:
    """Best k per query; the rank filter sits on the window, so each task cuts before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= MAX_RETRIEVAL_RESULTS)


def _asked(queries: DataFrame, k: int) -> DataFrame:
    requested = F.col("requested") if "requested" in queries.columns else F.lit(k)
    return queries.select(
        "query_id", F.col("embedding").cast("array<float>").alias("embedding"), clamp_results(requested, k).alias("k"),
    ).filter(F.col("embedding").isNotNull())


def _stored(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(
        F.col("embedding").isNotNull()
    )


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _arrow(batch: pa.RecordBatch | pa.Table, column: str) -> pa.DataType:
    return batch.schema.field(column).type


SUMMARY = "cell int, n long, outer double, inner double, nearest array<struct<distance:double,uri:string,content:string>>"


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        positions = np.arange(len(pivots))
        for batch in batches:
            if not batch.num_rows:
                continue
            _, cell, distance = _in_slices(as_matrix(batch.column("embedding")), pivots, positions, 1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column(
                "pivot_distance", pa.array(distance)
            )

    return vectors.mapInArrow(run, f"{fields}, cell int, pivot_distance double")


def summarize_cells(rows: DataFrame) -> DataFrame:
    """Per cell its size, radius, inner radius and the vectors nearest to its pivot: where ``rows`` name the document
    of a vector, with that, so that a reader can leave out those that are gone since."""
    named = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("uri", "content")]
    place = Window.partitionBy("cell").orderBy("pivot_distance")
    marked = rows.select("cell", "pivot_distance", *named).withColumn("_r", F.row_number().over(place))
    near = marked.filter(F.col("_r") <= MAX_RETRIEVAL_RESULTS).groupBy("cell").agg(
        F.collect_list(F.struct(F.col("pivot_distance").alias("distance"), "uri", "content")).alias("nearest")
    )
    sizes = rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("pivot_distance").alias("outer"), F.min("pivot_distance").alias("inner")
    )
    return sizes.join(near, "cell").select("cell", "n", "outer", "inner", "nearest")


def choose_pivots(stored: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors by hash of their ids: a few candidates more than needed, since copies would make empty cells."""
    order = F.md5(F.col("chunk_id").cast("string"))
    chosen = as_matrix(stored.orderBy(order, "chunk_id").limit(4 * pivots).toArrow().column("embedding"))
    _, first = np.unique(chosen, axis=0, return_index=True)
    return chosen[np.sort(first)[:pivots]]


def pivots_for(rows: int) -> int:
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, np.ceil(np.sqrt(rows)))))


def pivot_rows(spark: SparkSession, pivots: np.ndarray, first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + n, v.tolist()) for n, v in enumerate(pivots)], "cell int, pivot array<float>")


class CellIndex:
    """A corpus in cells: its rows (chunk_id, embedding, cell), the pivots, and a few numbers per cell. Cells
    without rows have no blocks and are never visited."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, summary: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        """``summary``: rows of SUMMARY; a cell may have several, of parts of it."""
        self.rows, self.pivots, self.block_rows = rows, pivots, block_rows
        count = len(pivots)
        self.outer, self.inner = np.full(count, -np.inf), np.full(count, np.inf)
        sizes = np.zeros(count, np.int64)
        known = summary.groupBy("cell").agg(
            F.sum("n").alias("n"), F.max("outer").alias("outer"), F.min("inner").alias("inner"),
            F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("nearest", lambda x: x["distance"])))), 1, MAX_RETRIEVAL_RESULTS).alias("heads"),
        ).toPandas()  # a row for each of at most MAX_PIVOTS cells
        cells = known["cell"].to_numpy(int)
        self.outer[cells], self.inner[cells], sizes[cells] = known["outer"], known["inner"], known["n"]
        self.sizes, self.blocks = sizes, -(-sizes // block_rows)
        heads = [np.asarray(h, float) for h in known["heads"]]
        self.head_cell = np.repeat(cells, [len(h) for h in heads]).astype(int)
        self.head_distance = np.concatenate([*heads, np.empty(0)])

    @classmethod
    def build(
        cls, chunks: DataFrame, path: str | None = None, *, pivots: int | None = None, block_rows: int = BLOCK_ROWS
    ) -> CellIndex:
        """Assign (chunk_id, embedding) to cells. Below ``path`` everything that ``open`` needs is written; without it
        the cells alone, to the shared folder, for one search."""
        spark = chunks.sparkSession
        stored = _stored(chunks)
        chosen = choose_pivots(stored, pivots_for(stored.count()) if pivots is None else pivots)
        assigned = assign_cells(_limit_copies(stored), chosen)
        if path is None:
            rows = materialize(assigned, "vector-cells")
            return cls(rows, chosen, summarize_cells(rows), block_rows)
        assigned.write.parquet(f"{path}/rows")
        pivot_rows(spark, chosen).coalesce(1).write.parquet(f"{path}/pivots")
        summarize_cells(spark.read.parquet(f"{path}/rows")).write.parquet(f"{path}/summary")
        return cls.open(spark, path, block_rows=block_rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, block_rows: int = BLOCK_ROWS) -> CellIndex:
        """An index written before; only pivots and summary are read."""
        pivots = as_matrix(spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow().column("pivot"))
        return cls(spark.read.parquet(f"{path}/rows"), pivots, spark.read.parquet(f"{path}/summary"), block_rows)

    def as_arrays(self) -> dict[str, np.ndarray]:
        """Plain arrays for the tasks; a broadcast class would need this package on the executors."""
        names = ("pivots", "outer", "inner", "blocks", "head_cell", "head_distance")
        return {name: getattr(self, name) for name in names}


def _probed_cells(
    queries: np.ndarray, cells: dict[str, np.ndarray], probes: int | None, known: np.ndarray | None = None
) -> np.ndarray:
    """Which cells each query visits: the nearest ``probes``, or all that may hold a result, which lies within the
    distance ``known`` of the query, if that is given."""
    asked, pivots = queries.astype(np.float64), cells["pivots"].astype(np.float64)
    squares = _square_norms(asked)[:, None] + _square_norms(pivots)[None, :] - 2 * (asked @ pivots.T)
    to_pivot = np.sqrt(np.maximum(squares, 0))
    filled = cells["blocks"] > 0
    if probes is not None:
        order = np.argsort(np.where(filled, to_pivot, np.inf), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros_like(to_pivot, dtype=bool)
        np.put_along_axis(wanted, order, True, axis=1)
        return wanted & filled
    reach = to_pivot[:, cells["head_cell"]] + cells["head_distance"][None, :]
    kth = min(MAX_RETRIEVAL_RESULTS, reach.shape[1]) - 1
    # Fewer stored vectors than k: nothing can be ruled out.
    bound = (
        np.partition(reach, kth, axis=1)[:, kth]
        if reach.shape[1] >= MAX_RETRIEVAL_RESULTS else np.full(len(queries), np.inf)
    )
    if known is not None:
        bound = np.minimum(bound, known)
    closest_possible = np.maximum(to_pivot - cells["outer"][None, :], cells["inner"][None, :] - to_pivot)
    # The product above is exact to about half the digits of a distance near zero.
    slack = 1e-6 * (1 + np.sqrt(squares.max()))
    return filled & (closest_possible <= (bound + slack)[:, None])


def _line(pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot along the direction in which they are spread most, by a few power steps."""
    spread = pivots.astype(np.float64) - pivots.mean(axis=0)
    along = spread[np.einsum("ij,ij->i", spread, spread).argmax()] if len(spread) else spread.sum(axis=0)
    for _ in range(8):
        along = spread.T @ (spread @ along)
        along /= max(np.sqrt(along @ along), 1e-30)
    return np.argsort(np.argsort(spread @ along, kind="stable"), kind="stable")


def _grouped(asked: DataFrame, cells: CellIndex, most: int | None = None) -> DataFrame:
    """Add ``query_block``: blocks of at most about ``most`` (block_rows) queries whose nearest pivots are neighbours."""
    most = most or cells.block_rows
    if asked.count() <= most:
        return asked.withColumn("query_block", F.lit(0))
    line = _line(cells.pivots)
    homes = materialize(assign_cells(asked, cells.pivots), "query-homes")
    sizes = np.zeros(len(line), np.int64)
    for row in homes.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MAX_PIVOTS rows
        sizes[line[row.cell]] = row.n
    # neighbours share a block until it is full; a pivot of many queries has several blocks of its own
    first, parts, last, held = np.zeros(len(line), int), np.ones(len(line), int), 0, 0
    for place, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            last, held = last + 1, 0
        first[place], parts[place] = last, max(1, -(-n // most))
        last, held = last + parts[place] - 1, n if parts[place] == 1 and not held else held + n
    named = asked.sparkSession.createDataFrame(
        [(int(c), int(first[line[c]]), int(parts[line[c]])) for c in range(len(line))], "cell int, first int, parts int"
    )
    block = F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
    return homes.join(named, "cell").select(*asked.columns, block.alias("query_block"))


def _visits(asked: DataFrame, cells: CellIndex, probes: int | None) -> tuple[DataFrame, DataFrame]:
    """One row per query and corpus block it must meet, and the (cell, query block) pairs that occur."""
    shared = asked.sparkSession.sparkContext.broadcast(cells.as_arrays())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            # Slices keep the query-by-pivot difference array small.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part, *np.nonzero(_probed_cells(as_matrix(part.column("embedding")), shared.value, probes))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q_at, cell in met(batches):
            both = np.unique(np.stack([cell, part.column("query_block").to_numpy()[q_at]]), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["cell", "query_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q_at, cell in met(batches):
            repeats = shared.value["blocks"][cell]
            q_all, cell_all = np.repeat(q_at, repeats), np.repeat(cell, repeats)
            offsets = np.arange(len(q_all)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            taken = part.take(pa.array(q_all))
            yield pa.RecordBatch.from_arrays(
                [taken.column("query_id"), taken.column("embedding"), taken.column("query_block"),
                 pa.array(cell_all.astype(np.int32)), pa.array(offsets.astype(np.int32))],
                names=["query_id", "embedding", "query_block", "cell", "block"],
            )

    given = asked.select("query_id", "embedding", "query_block")
    schema = f"query_id {_id_type(asked, 'query_id')}, embedding array<float>, query_block int, cell int, block int"
    occur = given.mapInArrow(pairs, "cell int, query_block int").distinct()
    return given.mapInArrow(run, schema), occur


def _as_rows(column: pa.ChunkedArray) -> np.ndarray:
    return as_matrix(column)


def _first_bound(asked: DataFrame, cells: CellIndex, stored: DataFrame, probes: int | None, k: int, read: Callable) -> DataFrame:
    """Add ``bound``: the distance of the kth nearest of the rows in the first block of each of the query's nearest
    cells. Any k rows give a bound that the k nearest of all cannot exceed; without k rows it is infinite."""
    first = min(probes or HOME_CELLS, HOME_CELLS)
    visits, occur = _visits(_grouped(asked, cells), cells, first)
    sizes = _cell_table(asked.sparkSession, cells, {"blocks": np.maximum(cells.blocks, 1)})
    wanted = sizes.join(occur, "cell").groupBy("cell", "blocks").agg(F.collect_set("query_block").alias("query_blocks"))
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    placed = stored.join(wanted, "cell").filter(block == 0).select("vector", "cell", F.explode("query_blocks").alias("query_block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query_type = _arrow(left, "query_id")
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], query_type), pa.array([], pa.list_(pa.float64()))], ["query_id", "near"])
        rows = read(right.column("vector"))
        q_at, _, near = _in_slices(as_matrix(left.column("embedding")), rows, np.arange(len(rows)), k)
        ends = np.append(0, np.cumsum(np.bincount(q_at, minlength=left.num_rows))).astype(np.int32)
        return pa.table([left.column("query_id"), pa.ListArray.from_arrays(ends, pa.array(near))], ["query_id", "near"])

    keys = ["cell", "query_block"]
    met = visits.filter("block = 0").groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(
        meet, f"query_id {_id_type(asked, 'query_id')}, near array<double>"
    )
    near = F.sort_array(F.flatten(F.collect_list("near")))
    kth = met.groupBy("query_id").agg(F.get(near, k - 1).alias("bound"))
    bounded = asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return materialize(bounded, "query-bounds")


def _cell_table(spark: SparkSession, cells: CellIndex, columns: dict[str, np.ndarray]) -> DataFrame:
    """One row for each of at most MAX_PIVOTS cells."""
    rows = [(c, *[int(x) for x in own]) for c, own in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, "cell int, " + ", ".join(f"{name} int" for name in columns))


class _Loads:
    """Neighbouring cells together, up to ``most`` rows; a larger cell is dealt over several loads of its own."""

    def __init__(self, cells: CellIndex, most: int) -> None:
        count = len(cells.pivots)
        self.first, self.parts, self.slot = np.zeros(count, int), np.ones(count, int), np.zeros(count, int)
        last, held, used = -1, most, 0
        members: list[list[int]] = []
        for cell in np.argsort(_line(cells.pivots)).tolist():
            n = int(cells.sizes[cell])
            if n > most:
                self.first[cell], self.parts[cell] = last + 1, -(-n // most)
                members += [[cell]] * int(self.parts[cell])
                last, held = last + int(self.parts[cell]), most
            elif n:
                if held + n > most:
                    last, held, used = last + 1, 0, 0
                    members.append([])
                self.first[cell], self.slot[cell] = last, used
                members[last].append(cell)
                held, used = held + n, used + 1
        #: For each load the cells in it, filled up with a number past the last cell.
        width = -(-max(map(len, members), default=1) // 8) * 8
        self.cells = np.full((len(members), width), count)
        for n, own in enumerate(members):
            self.cells[n, : len(own)] = own


def _sides(cells: CellIndex, queries: int, spark: SparkSession) -> tuple[int, int]:
    """Rows of a load and queries of a block: at most LOAD_ROWS, and fewer where that would leave cores idle."""
    side = int(np.ceil(np.sqrt(max(LEAST_PAIRS, 4 * spark.sparkContext.defaultParallelism))))
    loads = max(-(-int(cells.sizes.sum()) // LOAD_ROWS), side)
    blocks = max(-(-queries // LOAD_ROWS), -(-side * side // loads))
    return max(1024, -(-int(cells.sizes.sum()) // loads)), max(256, -(-queries // blocks))


def _join_loads(
    asked: DataFrame, cells: CellIndex, probes: int | None, stored: DataFrame | None = None, k: int = MAX_RETRIEVAL_RESULTS,
    read: Callable = _as_rows, like_cells: bool = True,
) -> DataFrame:
    """(query_id, chunk_id, distance): for each pair of a query and a load up to k of the closest rows.

    ``stored`` (chunk_id, vector, cell) and ``read`` stand for other rows than the full vectors of the index; where
    distances to them say nothing about cells, not ``like_cells``, the bound keeps out rows but no cells."""
    spark = asked.sparkSession
    stored = cells.rows.withColumnRenamed("embedding", "vector") if stored is None else stored
    bounded = _first_bound(asked, cells, stored, probes, k, read)
    load_rows, block_queries = _sides(cells, bounded.count(), spark)
    loads = _Loads(cells, load_rows)
    dealt = _grouped(bounded, cells, block_queries).select("query_id", "embedding", "bound", "query_block")
    shared = spark.sparkContext.broadcast((cells.as_arrays(), loads.cells))
    block_rows = cells.block_rows

    def wanted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bound = part.column("bound").to_numpy() if like_cells else None
                yield part, _probed_cells(as_matrix(part.column("embedding")), shared.value[0], probes, bound)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part, wanted in wanted_cells(batches):
            blocks = part.column("query_block").to_numpy()
            for own in np.unique(blocks).tolist():
                seen |= {(c, own) for c in np.flatnonzero(wanted[blocks == own].any(axis=0)).tolist()}
        both = np.array(sorted(seen), np.int32).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["cell", "query_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = shared.value[1]
        for part, wanted in wanted_cells(batches):
            bits = np.hstack([wanted, np.zeros((len(wanted), 1), bool)])[:, members]  # query, load, place in it
            q_at, load = np.nonzero(bits.any(axis=2))
            packed = np.packbits(bits[q_at, load], axis=1)
            ends = np.arange(len(q_at) + 1, dtype=np.int32) * packed.shape[1]
            visits = pa.Array.from_buffers(pa.binary(), len(q_at), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])
            taken = part.take(pa.array(q_at))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(load.astype(np.int32)), visits], names=[*taken.schema.names, "load", "visits"]
            )

    schema = f"query_id {_id_type(asked, 'query_id')}, embedding array<float>, bound double, query_block int"
    sent = dealt.mapInArrow(run, f"{schema}, load int, visits binary")
    occur = dealt.mapInArrow(pairs, "cell int, query_block int").distinct()
    places = _cell_table(spark, cells, {"first": loads.first, "parts": loads.parts, "slot": loads.slot})
    names = ["cell", "first", "parts", "slot"]
    wanted = places.join(occur, "cell").groupBy(*names).agg(F.collect_set("query_block").alias("query_blocks"))
    placed = stored.join(wanted, "cell").select(
        "chunk_id", "vector", "slot", (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int").alias("load"),
        F.explode("query_blocks").alias("query_block"),
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "distance"]
        query_type, chunk_type = _arrow(left, "query_id"), _arrow(right, "chunk_id")
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], query_type), pa.array([], chunk_type), pa.array([], pa.float64())], names)
        packed = left.column("visits").combine_chunks()
        bits = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(left.num_rows, -1)
        q_at, found, distance = _nearest_of_load(
            as_matrix(left.column("embedding")), left.column("bound").to_numpy(), np.unpackbits(bits, axis=1).astype(bool),
            read(right.column("vector")), _ids(right.column("chunk_id")), right.column("slot").to_numpy(), k, block_rows,
        )
        return pa.table([left.column("query_id").take(pa.array(q_at)), pa.array(found, chunk_type), pa.array(distance)], names)

    keys = ["load", "query_block"]
    return sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(
        meet, f"query_id {_id_type(asked, 'query_id')}, chunk_id {_id_type(stored, 'chunk_id')}, distance double"
    )


def _limit_copies(stored: DataFrame) -> DataFrame:
    """Of identical vectors only the lowest ids can rank within k; drop the others, exactly. Vectors are compared
    as such, and the rank filter sits on the window, so most copies drop out before the shuffle."""
    order = Window.partitionBy("embedding").orderBy("chunk_id")
    ranked = stored.withColumn("_copy", F.row_number().over(order))
    return ranked.filter(F.col("_copy") <= MAX_RETRIEVAL_RESULTS).select("chunk_id", "embedding")


def _blocked_topk(asked: DataFrame, cells: CellIndex, probes: int | None) -> DataFrame:
    """Copies of a query are answered once; the answers then go to all of them."""
    asked = materialize(asked, "vector-queries")  # an embedder is asked once
    distinct = asked.groupBy("embedding").agg(F.min("query_id").alias("query_id"))
    distinct = materialize(distinct, "distinct-queries")
    ranked = materialize(_rank(_join_loads(distinct, cells, probes)), "query-answers")
    own = asked.join(distinct.select(F.col("query_id").alias("_as"), "embedding"), "embedding").select("query_id", "k", "_as")
    answers = ranked.withColumnRenamed("query_id", "_as")
    # One vector may be asked by very many queries; only the answers to such are repeated.
    return spread_join(materialize(own, "asked-as"), answers, ["_as"], [F.col("query_id")], how="inner").filter(
        F.col("rank") <= F.col("k")
    ).drop("_as")


def _result(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


def _index(chunks: DataFrame | CellIndex, pivots: int | None, block_rows: int) -> CellIndex:
    if isinstance(chunks, CellIndex):
        return chunks
    return CellIndex.build(chunks, pivots=pivots, block_rows=block_rows)


def vector_topk(
    queries: DataFrame, chunks: DataFrame | CellIndex, k: int = 5, *, pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest chunks per query: (query_id, rank, chunk_id, distance).

    ``queries``: query_id, embedding and optionally ``requested`` (results wanted per query); ``chunks``: an
    index, or (chunk_id, embedding) rows to build one from. Ties break on the lower chunk id.
    """
    return _result(_blocked_topk(_asked(queries, k), _index(chunks, pivots, block_rows), None))


def vector_topk_ann(
    queries: DataFrame, chunks: DataFrame | CellIndex, k: int = 5, *, probes: int | None = None, recall: float = 0.95,
    pivots: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate k nearest chunks: only the ``probes`` cells closest to a query are searched. Without
    ``probes`` their number is chosen for the wanted recall by ``choose_probes``."""
    cells, asked = _index(chunks, pivots, block_rows), _asked(queries, k)
    return _result(_blocked_topk(asked, cells, probes or choose_probes(queries, cells, k, recall)))


def choose_probes(queries: DataFrame, cells: CellIndex, k: int = 5, recall: float = 0.95) -> int:
    """The fewest cells per query that hold the wanted share of the true neighbours, measured by an exact search
    for PROBE_SAMPLE queries picked by hash."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_SAMPLE)
    some = materialize(_asked(some, k), "probe-queries")
    exact = _blocked_topk(some, cells, None).select("query_id", "chunk_id")
    held = exact.join(cells.rows.select("chunk_id", "cell"), "chunk_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    found = some.join(held, "query_id").toArrow()  # at most PROBE_SAMPLE rows
    vectors = as_matrix(found.column("embedding")).astype(np.float64)
    filled = cells.blocks > 0
    squares = _square_norms(cells.pivots)[None, :] - 2 * (vectors @ cells.pivots.T.astype(np.float64))
    order = np.argsort(np.where(filled, squares, np.inf), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = [place[n, c] + 1 for n, own in enumerate(found.column("cells").to_pylist()) for c in own]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate result holds, over all queries."""
    hits = exact.select("query_id", "chunk_id").join(
        approximate.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left"
    )
    return hits.agg(
        F.count("*").alias("expected"), F.count("_hit").alias("found"),
        (F.count("_hit") / F.count("*")).alias("recall"),
    )
