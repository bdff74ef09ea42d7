"""Ranked lexical search by two trees: one over the items that ask, one over the documents.

A document is a point whose coordinates are its terms' weights in it; an item asks for some coordinates; a score is
the sum over these. A node of the documents' tree holds the greatest value of each coordinate below it, a node of
the items' tree all coordinates that any item below it asks for. Their product bounds every score below the pair.
Where it is less than the weakest kth score among the node's items, the whole batch of items and documents is passed
over; equal bounds are followed, since ties go to lower ids. So the result is exact.

1. Items come in blocks of at most BLOCK_TERMS terms. One pass over the texts counts the block's terms in each
   document (a written table: id, number of terms, term numbers, frequencies); document frequencies and sizes are
   sums over it.
2. Documents are dealt by range of their two weightiest terms and their id, so that near ones lie together and no
   term's documents share a task. In a task up to CHUNK documents at a time get a tree: leaves of LEAF neighbours,
   then FAN nodes under one.
3. A first pass scores only the best leaf of each chunk for each item. The kth best of these is where the second
   pass starts from: every task walks down both trees with it and with what it finds, and returns its k best.
4. The k best of all tasks' rows, per item.

Weights are whole numbers: term weight floor(1000 ln((2N+2)/(2df+1))) times (10^9 tf) div (1000 tf + 20 m), with
m = 50 + (50 n N) div L. Sums stay below 2^53 for items of up to half a million terms, so doubles add them exactly.

Defined cases: texts that are null or without terms are no documents and no items; rows of one item_id are one item
with the terms of all; every row of ``docs`` is a document of its own; null doc_ids rank last among equal scores;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwire.llm.common import give_back, small_batches, spread
from groundwire.plans.workspace import materialize

BLOCK_TERMS = 500_000
CHUNK, CHUNK_POSTINGS, LEAF, FAN = 8192, 1_000_000, 32, 4
#: What splits terms becomes a blank: ASCII other than digits and letters; A-Z become a-z, bytes above stay.
_BYTES = bytes(
    n + 32 if 65 <= n <= 90 else n if 48 <= n <= 57 or 97 <= n <= 122 or n > 127 else 32 for n in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split(b" ") if text else []


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Lists of (item, its terms), each item once, with at most BLOCK_TERMS terms in all but for a longer item."""
    rows = items.select(F.col(item_id).alias("item"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    block, size, last, found = [], 0, None, set()

    def close():
        nonlocal size
        if found:
            block.append((last, frozenset(found)))
            size += len(found)

    first = True
    for row in rows.orderBy("item").toLocalIterator():
        if first or row.item != last:
            close()
            if size >= BLOCK_TERMS:
                yield block
                block, size = [], 0
            first, last, found = False, row.item, set()
        found |= set(terms_of(bytes(row.text))) - {b""}
    close()
    if block:
        yield block


def _counted(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Columns doc_id, n (number of terms), terms, tf: the counts of the vocabulary in each document with a term."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    lists = pa.list_(pa.int32())
    kind = pa.struct([("n", pa.int64()), ("terms", lists), ("tf", lists)])

    @F.arrow_udf("struct<n:bigint,terms:array<int>,tf:array<int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = shared.value.get
        for batch in batches:
            sizes, ends, terms, tf = [], [0], [], []
            for each in batch.cast(pa.binary()):
                found = terms_of(each.as_py())
                counts = Counter(map(number, found))
                counts.pop(None, None)
                sizes.append(len(found) - found.count(b""))
                terms.extend(counts)
                tf.extend(counts.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf)]],
                fields=list(kind),
            )
        give_back()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), count(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    return given.select("doc_id", "c.*").filter("n > 0")


def _weighed(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Columns doc_id, terms, impacts of documents that score at all, near ones in one range partition."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L").alias("m")
    kind = pa.struct([("first", pa.int32()), ("second", pa.int32()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<first:int,second:int,terms:array<int>,impacts:array<bigint>>")
    def weigh(ms: pa.Array, terms: pa.Array, tfs: pa.Array) -> pa.Array:
        bounds = terms.offsets.to_numpy()
        bounds = bounds - bounds[0]
        sizes = np.diff(bounds)
        code, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype("i8")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        impact = shared.value[code] * (1_000_000_000 * tf // (1000 * tf + 20 * ms.to_numpy()[owner]))
        order = np.lexsort((code, -impact, owner))
        code, impact, owner = code[order], impact[order], owner[order]
        top = np.full((2, len(sizes)), -1, "i4")
        for k in range(2):
            some = np.flatnonzero(sizes > k)
            top[k, some] = np.where(impact[bounds[some] + k] > 0, code[bounds[some] + k], -1)
        kept = impact > 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(sizes)))]).astype("i4")
        lists = [pa.ListArray.from_arrays(ends, x[kept]) for x in (code, impact)]
        return pa.StructArray.from_arrays([pa.array(top[0]), pa.array(top[1]), *lists], fields=list(kind))

    placed = counted.select("doc_id", weigh(m, "terms", "tf").alias("w")).select("doc_id", "w.*").filter("first >= 0")
    key = ["first", "second", "doc_id"]
    dealt = placed.repartitionByRange(spread(counted), *key).sortWithinPartitions(*key)
    return materialize(dealt.drop("first", "second"), "weighed-documents")


class ItemTree:
    """Items in levels of nodes: level 0 has the items, a node above it FAN neighbours of the level below. Items
    that share their weightiest terms are neighbours. Each node has the terms of all items below it."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        by_weight = [sorted(own.tolist(), key=lambda t: (-weights[t], t)) for own in items]
        self.order = sorted(range(len(items)), key=lambda n: by_weight[n][:3])
        level = [items[n] for n in self.order]
        self.levels = [level]
        while len(level) > 1:
            level = [np.unique(np.concatenate(level[a : a + FAN])) for a in range(0, len(level), FAN)]
            self.levels.append(level)

    def bounds(self, level: int, nodes: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """The products of nodes with a vector of values per term; a matrix of them gives one column for each."""
        own = [self.levels[level][n] for n in nodes]
        starts = np.cumsum([0, *map(len, own[:-1])])
        return np.add.reduceat(greatest[np.concatenate(own)], starts, axis=0)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes one level down."""
        held = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return held[held < len(self.levels[level - 1])]


class DocumentTree:
    """Neighbouring documents in levels of nodes with the greatest impact of each term; level 0 has leaves."""

    def __init__(self, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.owner, self.terms, self.impacts = owner, terms, impacts
        self.starts = np.searchsorted(owner, np.arange(0, owner[-1] + 1 + LEAF, LEAF))
        self.scratch = np.zeros(vocabulary)
        self.levels = []
        node, value = owner // LEAF, impacts
        while True:
            order = np.lexsort((terms, node))
            key = node[order] * vocabulary + terms[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            value, node, terms = np.maximum.reduceat(value[order], first), node[order][first], terms[order][first]
            nodes = int(node[-1]) + 1
            self.levels.append((np.searchsorted(node, np.arange(nodes + 1)), terms, value))
            if nodes == 1:
                break
            node = node // FAN

    def greatest(self, level: int, node: int) -> np.ndarray:
        """The node's value of every term, in a vector that the next call overwrites."""
        bounds, terms, value = self.levels[level]
        self.scratch[:] = 0
        own = slice(bounds[node], bounds[node + 1])
        self.scratch[terms[own]] = value[own]
        return self.scratch

    def below(self, level: int, node: int) -> range:
        return range(node * FAN, min(node * FAN + FAN, len(self.levels[level - 1][0]) - 1))

    def points(self, leaf: int) -> tuple[int, np.ndarray]:
        """The number of the leaf's first document, and its documents' values (terms x documents)."""
        own = slice(self.starts[leaf], self.starts[leaf + 1])
        held = np.zeros((len(self.scratch), LEAF))
        held[self.terms[own], self.owner[own] - leaf * LEAF] = self.impacts[own]
        return leaf * LEAF, held


class Search:
    """The k best documents found so far for each item, and the walk that finds them."""

    def __init__(self, tree: ItemTree, k: int, floors: np.ndarray):
        self.tree, self.k = tree, k
        self.best = [(np.empty(0), np.empty(0, "?"), np.empty(0, "i8")) for _ in tree.order]
        # no score below 1 counts; a floor is a kth score that is known to be reached
        self.weakest = [np.maximum(1.0, floors[tree.order])]
        self.scored = 0
        self._lift()

    def _lift(self) -> None:
        del self.weakest[1:]
        while len(self.weakest[-1]) > 1:
            low = self.weakest[-1]
            self.weakest.append(np.minimum.reduceat(low, np.arange(0, len(low), FAN)))

    def score(self, documents: DocumentTree, leaf: int, items: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Score all documents of a leaf for some items, exactly."""
        begin, points = documents.points(leaf)
        scores = self.tree.bounds(0, items, points)[:, : len(ids) - begin]
        self.scored += scores.size
        hits = scores >= self.weakest[0][items][:, None]
        for row in np.flatnonzero(hits.any(axis=1)):
            item, at = items[row], np.flatnonzero(hits[row])
            held = self.best[item]
            score, null, id_ = (np.concatenate(x) for x in zip(held, (scores[row, at], nulls[begin + at], ids[begin + at])))
            if len(score) >= self.k:
                order = np.lexsort((id_, null, -score))[: self.k]
                score, null, id_ = score[order], null[order], id_[order]
                self.weakest[0][item] = max(self.weakest[0][item], score[-1])
            self.best[item] = (score, null, id_)
        if hits.any():
            self._lift()

    def walk(self, documents: DocumentTree, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Down both trees, the more promising of a node's children first."""
        top = len(self.tree.levels) - 1
        stack = [(len(documents.levels) - 1, 0, top, np.array([0]))]
        while stack:
            level, node, depth, nodes = stack.pop()
            greatest = documents.greatest(level, node)
            open_ = nodes[self.tree.bounds(depth, nodes, greatest) >= self.weakest[depth][nodes]]
            while depth and len(open_):
                depth, open_ = depth - 1, self.tree.below(depth, open_)
                bounds = self.tree.bounds(depth, open_, greatest)
                open_ = open_[bounds >= self.weakest[depth][open_]]
                if level:
                    break  # the documents' tree goes down next
            if not len(open_):
                continue
            if level:
                children = documents.below(level, node)
                worth = [self.tree.bounds(depth, open_, documents.greatest(level - 1, child)).sum() for child in children]
                stack += [(level - 1, child, depth, open_) for _, child in sorted(zip(worth, children))]
            else:
                self.score(documents, node, open_, ids, nulls)

    def prime(self, documents: DocumentTree, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Score each item in the one leaf with the greatest bound."""
        items = np.arange(len(self.tree.order))
        leaves = len(documents.levels[0][0]) - 1
        best, where = np.zeros(len(items)), np.zeros(len(items), "i8")
        for leaf in range(leaves):
            bounds = self.tree.bounds(0, items, documents.greatest(0, leaf))
            better = bounds > best
            best[better], where[better] = bounds[better], leaf
        for leaf in np.unique(where[best > 0]):
            self.score(documents, int(leaf), items[(where == leaf) & (best > 0)], ids, nulls)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for batch in batches:
        at = 0
        ends = batch.column("terms").offsets.to_numpy()
        while at < len(batch):
            room = int(np.searchsorted(ends, ends[at] + CHUNK_POSTINGS - postings, "right")) - 1
            to = min(len(batch), at + CHUNK - rows, max(room, at + (not held)))
            if to > at:
                held.append(batch.slice(at, to - at))
                rows, postings = rows + to - at, postings + int(ends[to] - ends[at])
            at = to
            if at < len(batch) or rows >= CHUNK:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _found(weighed: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int, floors: np.ndarray, prime: bool) -> DataFrame:
    """Each task's best rows (item, doc_id, score)."""
    shared = weighed.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for chunk in _chunks(batches):
            if search is None:
                search = Search(ItemTree(*shared.value[:2]), k, shared.value[2])
            terms, column = chunk.column("terms").combine_chunks(), chunk.column("doc_id").combine_chunks()
            owner = np.repeat(np.arange(len(column)), np.diff(terms.offsets.to_numpy()))
            impacts = chunk.column("impacts").combine_chunks().flatten().to_numpy().astype("f8")
            tree = DocumentTree(owner, terms.flatten().to_numpy().astype("i8"), impacts, len(shared.value[1]))
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            (search.prime if prime else search.walk)(tree, column.fill_null(0).to_numpy(), nulls)
        for at, (score, null, id_) in zip(search.tree.order, search.best) if search else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), at, "i4")), pa.array(id_, mask=null), pa.array(score.astype("i8"))], ["item", "doc_id", "score"]
            )
        give_back()

    return weighed.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Columns item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    kind = items.select(F.col(item_id).alias("item_id")).schema
    out = None
    for block in _item_blocks(items, item_id, item_text):
        vocabulary = {term: n for n, term in enumerate(sorted(frozenset().union(*[terms for _, terms in block])))}
        asked = [np.array(sorted(vocabulary[t] for t in terms)) for _, terms in block]
        counted = materialize(_counted(docs, doc_id, text, vocabulary), "term-counts")
        sums = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not sums.docs:
            break
        held = np.zeros(len(vocabulary), "i8")
        for row in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            held[row.t] = row.df
        weights = np.array([math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * df + 1))) for df in held.tolist()], "i8")
        weighed = _weighed(counted, weights, sums.docs, sums.terms)
        primed = _ranked(_found(weighed, asked, weights, k, np.zeros(len(block)), prime=True), k).filter(F.col("rank") == k)
        floors = np.zeros(len(block))
        for row in primed.select("item", "score").collect():
            floors[row.item] = row.score
        best = _ranked(_found(weighed, asked, weights, k, floors, prime=False), k)
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"item int, item_id {kind[0].dataType.simpleString()}")
        part = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        if out is None:
            out = part
        else:
            out = materialize(out, "ranked-block").unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind[0].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
