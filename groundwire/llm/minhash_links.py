"""Near-duplicate documents: an inverted join on signature coordinates, confirmed on full shingle sets.

1. Each text becomes its set of word shingles; equal sets form one class, only its smallest document goes on.
2. A MinHash signature of ``coordinates`` values; each (coordinate, value) is a posting key. Two sets of
   the wanted similarity agree in ``least`` coordinates or more but for a chance of ``miss``.
3. Merging with prefix and skip: values nobody shares and documents with fewer than ``least`` shared values
   drop out; of s shared values the rarest s - least + 1 are posted, since a partner with ``least`` matches
   must meet one of them. The long lists of frequent values are skipped.
4. Within a list nobody meets everybody: documents first meet a hub, chosen per list by hash. The collisions
   of a pair are counted on the signatures and pairs above the threshold confirmed on the sets; documents
   that confirmed links join need not meet again. Only lists that still hold several components are gone
   through in full, all but the largest component against everyone, inside tasks that return joined
   documents, never pairs: no link between components is lost, and none within one is looked for.

Defined cases: null and blank texts have the empty set and no links; texts shorter than a shingle are one
shingle; rows that share a doc_id are one document; rows without doc_id are never linked and stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.functions.text import compute_once
from groundwire.llm.common import ascii_lower, components, give_back, packed, small_batches, unpacked, with_shingles
from groundwire.plans.workspace import materialize

COORDINATES = 48  # at most 63, the bits of a long
SLICE = 400_000
#: Shingles of the documents a comparing task holds on either side, but for single longer documents.
BLOCK = 400_000


def least_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The most matches a pair of this similarity reaches with chance 1 - ``miss`` or better."""
    below, least = 0.0, 0
    while least < coordinates:
        below += comb(coordinates, least) * similarity**least * (1 - similarity) ** (coordinates - least)
        if below > miss:
            break
        least += 1
    return max(1, least)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Columns doc_id and shingles, the distinct 64-bit shingle hashes of the lower-cased text."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = with_shingles(named, ascii_lower(F.coalesce("text", F.lit(""))), words, "all").drop("text")
    return compute_once(hashed, {"shingles": F.array_distinct("all")}).drop("all")


def _signer(coordinates: int):
    draw = np.random.default_rng(9)
    factors = draw.integers(1, 2**63, coordinates, dtype="u8") * np.uint64(2) + np.uint64(1)
    offsets = draw.integers(0, 2**63, coordinates, dtype="u8")
    mix = np.uint64(0x9E3779B97F4A7C15)
    kind = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("signature", pa.list_(pa.int32()))])

    def signed(values: np.ndarray, bounds: np.ndarray) -> tuple:
        """Order-free checksums and signatures of non-empty runs of ``values``."""
        first = np.add.reduceat(values * mix ^ values >> np.uint64(29), bounds)
        second = np.add.reduceat((values ^ values >> np.uint64(31)) * factors[0] >> np.uint64(7), bounds)
        signature = np.empty((len(bounds), coordinates), "u4")
        for n in range(coordinates):
            signature[:, n] = np.minimum.reduceat((values * factors[n] + offsets[n] >> np.uint64(32)).astype("u4"), bounds)
        return first.view("i8"), second.view("i8"), signature.view("i4")

    def sign(shingles: pa.Array) -> pa.Array:
        ends = shingles.offsets.to_numpy()
        values = shingles.values.to_numpy(zero_copy_only=False).view("u8")
        full = np.flatnonzero(np.diff(ends))
        low, high = np.zeros(len(shingles), "i8"), np.zeros(len(shingles), "i8")
        signature = np.zeros((len(shingles), coordinates), "i4")
        at = 0
        while at < len(full):
            begin = ends[full[at]]
            to = max(at + 1, int(np.searchsorted(ends[full + 1], begin + SLICE, "right")))
            some = full[at:to]
            parts = signed(values[begin : ends[some[-1] + 1]], ends[some] - begin)
            low[some], high[some], signature[some] = parts
            at = to
        lists = pa.ListArray.from_arrays(np.arange(len(shingles) + 1, dtype="i4") * coordinates, pa.array(signature.ravel()))
        return pa.StructArray.from_arrays([pa.array(low), pa.array(high), lists], fields=list(kind))

    @F.arrow_udf("struct<low:bigint,high:bigint,signature:array<int>>")
    def sign_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(sign, batches)
        give_back()

    return sign_all


def _matches(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """Columns token, node, earlier: the rarest shared values of each class, enough to meet every partner, and
    as bits the coordinates it posted before this one; all classes post in one order, rarest value first."""
    low = F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))  # without its sign, which would reach into n
    tokens = classes.select(F.col("node"), F.posexplode("signature").alias("n", "v")).select(
        "node", (F.shiftleft(F.col("n").cast("long"), 32) + low).alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    met = tokens.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("own"))
    kept = compute_once(met.filter(F.size("own") >= least), {
        "posted": F.slice(F.sort_array("own"), F.lit(1), F.size("own") - least + 1)
    })
    posted = kept.select("node", "posted", F.posexplode("posted").alias("at", "p"))

    def mark(seen: Column, p: Column) -> Column:
        coordinate = F.shiftright(p["token"], 32).cast("int")
        return seen.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), coordinate))

    earlier = F.aggregate(F.slice("posted", F.lit(1), F.col("at")), F.lit(0).cast("long"), mark)
    return posted.select(F.col("p.token").alias("token"), "node", earlier.alias("earlier"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum")
    )
    return met.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _above(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) with enough collisions, and their number."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    counted = compute_once(pairs.join(left, "a").join(right, "b"), {"hits": _matches("x", "y")})
    return counted.filter(F.col("hits") >= least).select("a", "b", "hits")


def _comparer(least: int, percent: int):
    """Compare the asking documents of one list (or block of it) with the others, on signatures and then on
    sets, and return one edge (a, b) for each document that links join to a smaller one. A pair is compared in
    the first list that both are posted in, and in no other."""
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        plain = {c: group.column(c).combine_chunks().to_numpy() for c in ("node", "comp", "size", "earlier")}
        top = group.column("top")[0].as_py()
        sets = group.column("shingles").combine_chunks()
        ends, every = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False)
        signatures = group.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asks), -1)
        asking, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
        links: dict[int, int] = {}

        def root(n: int) -> int:
            while links.setdefault(n, n) != n:
                links[n] = n = links[links[n]]
            return n

        if len(asking) and len(rest):
            nodes, comps, sizes = (plain[c][rest] for c in ("node", "comp", "size"))
            signed = signatures[rest]
            bits = np.arange(signed.shape[1])
            earlier = (plain["earlier"][rest][:, None] >> bits & 1).astype(bool)
            values = None
            for at_row in asking:
                node, comp, size, before = (plain[c][at_row] for c in ("node", "comp", "size", "earlier"))
                signature = signatures[at_row]
                wanted = (comps != comp) & ((comps == top) | (node < nodes))
                wanted &= 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
                if not wanted.any():
                    continue
                equal = signed == signature
                wanted &= equal.sum(axis=1) >= least
                if before:
                    own = np.flatnonzero(before >> bits & 1)
                    wanted &= ~(equal[:, own] & earlier[:, own]).any(axis=1)
                if not wanted.any():
                    continue
                if values is None:
                    values = np.concatenate([every[ends[n] : ends[n + 1]] for n in rest])
                    order = np.argsort(values, kind="stable")
                    values, holder = values[order], np.repeat(np.arange(len(nodes)), sizes)[order]
                shingles = every[ends[at_row] : ends[at_row + 1]]
                low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
                length = high - low
                at = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
                both = np.bincount(holder[at], minlength=len(nodes))
                for n in nodes[wanted & (100 * both >= percent * (sizes + size - both))].tolist():
                    x, y = root(int(node)), root(n)
                    links[max(x, y)] = min(x, y)
        joined = [(n, root(n)) for n in list(links)]
        edges = np.array([x for x in joined if x[0] != x[1]], "i8").reshape(-1, 2)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def _apart(member: DataFrame, sets: DataFrame, signatures: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between components that still share a list: all documents but those of the largest component ask
    all others. Long lists are dealt into blocks of about BLOCK shingles, and no pair ever becomes a row."""
    sized = sets.select("node", F.size("shingles").alias("size"))
    held = member.join(sized, "node")
    parts = held.groupBy("token", "comp").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    lists = parts.groupBy("token").agg(
        F.max(F.struct("m", "comp", "size")).alias("most"), F.count("*").alias("k"), F.sum("size").alias("all")
    ).filter("k > 1").select(
        "token", F.col("most.comp").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("most.size")) / BLOCK).cast("int").alias("turns"),
    )
    dealt = held.join(lists, "token")

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["token", "turn", "block"]
    rows = [*key, "node", "comp", "top", "size", "earlier", "asks"]
    asking = dealt.filter("comp <> top").withColumn("turn", own("turns")).withColumn("block", every("blocks"))
    other = dealt.withColumn("block", own("blocks")).withColumn("turn", every("turns"))
    both = asking.withColumn("asks", F.lit(True)).select(rows).unionByName(other.withColumn("asks", F.lit(False)).select(rows))
    full = both.join(signatures.join(sets, "node"), "node")
    return full.groupBy(*key).applyInArrow(_comparer(least, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85,
    coordinates: int = COORDINATES, miss: float = 1e-6, rounds: int = 2, among: DataFrame | None = None,
) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept: one row per row of ``docs``. ``among`` (a column doc_id): only
    these documents are linked with each other; the others are dropped before texts or signatures are dealt."""
    least = least_matches(coordinates, percent / 100, miss)
    small_batches(docs.sparkSession, 2000)
    signed = compute_once(shingle_sets(docs, doc_id, text, words), {"s": _signer(coordinates)(F.col("shingles"))})
    prepared = materialize(
        signed.select("doc_id", F.size("shingles").alias("n"), "s.low", "s.high", "s.signature"), "signatures"
    )
    if among is not None:
        prepared = prepared.join(among.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    key = ["n", "low", "high"]
    able = prepared.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        able.groupBy(key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes"
    )
    postings = materialize(_postings(classes, least), "postings")
    nodes = postings.select("node").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    sets = shingle_sets(texts.join(nodes, "node", "left_semi"), "node", "text", words)
    sets = materialize(sets.withColumnRenamed("doc_id", "node"), "sets")
    signatures = materialize(
        classes.select("node", "signature").join(nodes, "node", "left_semi"), "posted-signatures"
    )

    links = found = None
    member = postings.withColumn("comp", F.col("node"))
    for turn in range(rounds):
        order = F.struct(F.xxhash64(F.lit(turn), "token", "node").alias("o"), "node", "comp")
        hubs = member.groupBy("token").agg(F.min(order).alias("hub"), F.min("comp").alias("c"), F.max("comp").alias("d"))
        stars = member.join(hubs.filter("c <> d").select("token", "hub"), "token").filter("comp <> hub.comp")
        pairs = stars.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        best = _above(pairs, signatures, least).groupBy("a").agg(F.max(F.struct("hits", "b")).alias("best"))
        confirmed = _confirm(best.select("a", F.col("best.b").alias("b")), sets, percent)
        links = materialize(confirmed if links is None else links.unionByName(confirmed), "confirmed")
        found, member = _joined(links, postings)
    apart = materialize(_apart(member, sets, signatures, least, percent), "confirmed")
    if apart.head(1):
        found = components(links.unionByName(apart), "a", "b")
    located = prepared.join(classes.select(*key, "node"), key, "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return located.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def _joined(links: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of the links so far, and the postings with theirs."""
    found = materialize(components(links, "a", "b"), "components")
    named = postings.join(found, "node", "left").select("token", "node", "earlier", F.coalesce("component", "node").alias("comp"))
    return found, materialize(named, "members")


def without_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", texts: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component. ``texts`` (doc_id, text), if given, are
    compared in place of the documents' own: as they were before lines were taken out, say. Documents that it does
    not hold are compared by their own text."""
    compared = docs
    if texts is not None:
        ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
        held = texts.select(F.col("doc_id").cast("long").alias("doc_id"))
        missing = ids.join(held.distinct(), "doc_id", "left_anti").distinct()
        columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(options.pop("text", "text")).alias("text")]
        compared = texts.select("doc_id", "text")
        if missing.filter("doc_id IS NOT NULL").head(1):
            compared = compared.unionByName(docs.select(*columns).join(missing, "doc_id", "left_semi"))
        options |= {"among": ids}
    found = near_duplicates(compared, doc_id=doc_id if texts is None else "doc_id", **options)
    lost = found.filter("NOT kept").select("doc_id").distinct()
    own = packed(docs, doc_id=F.col(doc_id).cast("long"))
    return unpacked(own.join(lost, "doc_id", "left_anti"), docs.columns)
