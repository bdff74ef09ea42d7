"""Near-duplicate embeddings through a robust-pruned flat graph.

Equal vectors form one class, only its smallest goes on. Pivots (at most PIVOTS in all, a hash sample that lies apart,
shared among labels by size) cut each label into clusters: the nearest pivot is a vector's home. A vector a with home
p can only be linked to a vector at home in q if the half-space nearer to q is within the link angle of a, that is
a.(p - q) <= sin(angle) |p - q|. A vector also visits every cluster of higher number that passes, so clusters overlap
and each linked pair is together in the cluster of the higher home, whatever the sample. A shard is a part of the
vectors at home in a cluster, at most ``cap`` of them, with as many of its other vectors, visitors or other parts.

1. Build. The list of a vector at home in a shard is pruned: the nearest candidate of its part stays and rules out
   every vector of the shard that is nearer to it (``alpha`` times) than to the vector itself; so on with the next
   of the part that is left; of the others those stay that nobody rules out. No list is cut at a length.
2. Unite. The lists that a vector has in its shards are joined to one: the flat graph, a written table.
3. Search. For each vector at home a greedy walk over the united lists starts at the medoid of its part. If a vector
   of the shard is not on the list of one at home, that list holds another one at home that is nearer to it. So the
   walk ends at the vector itself; and from there a path that only comes nearer leads to each partner, on which no
   vector is further away than twice the link distance. A search that expands everything within that range meets
   every partner.
4. Verify. What a search met is compared in double precision. A link counts for the vector that searched, and for a
   visitor that was found, which does not search there.
5. Audit. A sample of vectors, more where it holds few links, is compared with all others; the mean of their recalls
   is returned, null where the sample holds no link.

Tasks return one row per vector with its number of links and its component within the shard, never the pairs. A shard's
distances take 4 bytes for each of at most 2 ``cap`` times ``cap`` pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without
label or vec_id, have no links; only vectors of one length are compared; rows that share a vec_id are one
vector for components, and each other's links are not counted; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwire.functions.text import compute_once
from groundwire.llm.common import components
from groundwire.plans.workspace import materialize

PIVOTS, AUDIT, AUDIT_MOST, AUDIT_LINKS = 4096, 500, 2000, 100
SLICE = 1000
#: How far single precision may be off in a distance between unit vectors, for all steps of a path together.
LOOSE = 4e-3
SPACE = ["label", "dim"]
GROUP = [*SPACE, "cluster", "part", "with"]


def _unit(vectors) -> np.ndarray:
    held = np.stack([np.asarray(v, "f8") for v in vectors])
    scaled = held / np.abs(held).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, label, embedding, able), and one row per class of equal vectors that can link."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = (
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(embedding).alias("embedding"), able.alias("able"),
    )
    classes = rows.filter("able").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("m")
    )
    return rows, classes.withColumn("dim", F.size("embedding"))


def apart(unit: np.ndarray, threshold: float) -> np.ndarray:
    """The rows in order, but for those linked to an earlier one that stays: a dense group is one cluster then."""
    kept = np.empty_like(unit)
    n = 0
    for row in unit:
        if not (kept[:n] @ row >= threshold).any():
            kept[n] = row
            n += 1
    return kept[:n]


def _pivots(classes: DataFrame, target: int, threshold: float) -> dict:
    """Per (label, dim): unit pivots that lie apart, enough for clusters of ``target`` and at most PIVOTS in all."""
    sizes = classes.groupBy(*SPACE).agg(F.count("*").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = F.floor(F.col("size") * PIVOTS / F.lit(max(1, total)))
    wanted = sizes.withColumn("k", F.least(F.ceil(F.col("size") / target), share)).filter("k > 1").select(*SPACE, "k")
    place = F.xxhash64(F.lit(10), "node")
    some = classes.join(wanted, SPACE).withColumn("at", F.row_number().over(W.partitionBy(*SPACE).orderBy(place, "node")))
    held: dict = {}
    for row in some.filter("at <= k").select(*SPACE, "at", "embedding").orderBy("at").toLocalIterator():
        held.setdefault((row.label, row.dim), []).append(row.embedding)
    return {space: apart(_unit(rows), threshold) for space, rows in held.items()}


def _assigned(classes: DataFrame, pivots: dict, threshold: float) -> DataFrame:
    """Each class once for each cluster it visits: columns of SPACE, cluster, home, node, m, embedding."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    reach = np.sqrt(1 - threshold**2) if threshold > 0 else np.inf

    def visits(vectors: list, own: np.ndarray) -> Iterator[list]:
        for begin in range(0, len(vectors), SLICE):
            near = _unit(vectors[begin : begin + SLICE]) @ own.T
            homes = near.argmax(axis=1)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (own[homes] @ own.T)))
            open_ = near[np.arange(len(near)), homes][:, None] - near <= (reach * (apart + 1e-6) + 1e-9)
            for home, row in zip(homes.tolist(), open_):
                yield [home, *(home + 1 + np.flatnonzero(row[home + 1 :])).tolist()]

    @F.arrow_udf("array<int>")
    def visited(labels: pa.Array, dims: pa.Array, vectors: pa.Array) -> pa.Array:
        out: list = [[0]] * len(labels)
        spaces = pd.Series(list(zip(labels.to_pylist(), dims.to_pylist())))
        for space, at in spaces.groupby(spaces).groups.items():
            own = shared.value.get(space)
            if own is not None:
                for n, clusters in zip(at, visits([vectors[int(n)].as_py() for n in at], own)):
                    out[n] = clusters
        return pa.array(out, pa.list_(pa.int32()))

    bound = compute_once(classes, {"clusters": visited("label", "dim", "embedding")})
    spread = bound.select("node", "m", *SPACE, "embedding", F.posexplode("clusters").alias("rank", "cluster"))
    return spread.withColumn("home", F.col("rank") == 0).drop("rank")


def distances(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """From unit vectors to each other, the same in both directions, and then to others; in single precision."""
    near = (own @ own.T).astype("f4")
    near = np.hstack([np.minimum(near, near.T), (own @ others.T).astype("f4")])
    return np.sqrt(np.maximum(0, 2 - 2 * near))


def prune(distance: np.ndarray, alpha: float = 1.0) -> list[np.ndarray]:
    """The pruned list of every row's point among all columns' points; the first columns are the rows' points. The
    nearest of these stays and rules out what is more than ``alpha`` times as near to it as to the row's point, and
    so on; other points stay if nobody rules them out."""
    n = len(distance)
    open_ = distance.copy()
    np.fill_diagonal(open_, np.inf)
    rows, lists = np.arange(n), [[] for _ in range(n)]
    while len(rows):
        pick = open_[:, :n].argmin(axis=1)
        left = np.isfinite(open_[np.arange(len(rows)), pick])
        for row, rest in zip(rows[~left].tolist(), open_[~left, n:]):
            lists[row].extend((n + np.flatnonzero(np.isfinite(rest))).tolist())
        if not left.all():
            rows, pick, open_ = rows[left], pick[left], open_[left]
        for row, at in zip(rows.tolist(), pick.tolist()):
            lists[row].append(at)
        open_[alpha * distance[pick] < distance[rows]] = np.inf
        open_[np.arange(len(rows)), pick] = np.inf
    return [np.array(own, "i4") for own in lists]


def medoid(unit: np.ndarray) -> int:
    return int((unit @ unit.mean(axis=0)).argmax())


def search(unit: np.ndarray, lists: list[np.ndarray], start: int, at: int, reach: float) -> tuple[np.ndarray, int]:
    """The points that a search for point ``at`` meets, and how many the walk passed: greedily from ``start`` until
    no neighbour is nearer, then through everything within ``reach``. Points without a list are met only."""
    query, n = unit[at], len(lists)
    here, near, steps = start, np.inf, 0
    while here != at:
        found = lists[here]
        found = found[found < n]
        away = np.square(unit[found] - query).sum(axis=1)
        best = away.argmin() if len(found) else None
        if best is None or not away[best] < near:
            here = at  # neighbours as near as rounding can tell; the point itself is in the shard
            break
        here, near, steps = int(found[best]), away[best], steps + 1
    met = np.zeros(len(unit), bool)
    met[here] = True
    edge = np.array([here])
    while len(edge):
        new = np.unique(np.concatenate([lists[k] for k in edge]))
        new = new[~met[new]]
        met[new] = True
        new = new[new < n]
        edge = new[np.square(unit[new] - query).sum(axis=1) <= reach * reach]
    met[at] = False
    return np.flatnonzero(met), steps


def _parted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int]:
    """The shard's vectors, those of its own part first, and how many these are."""
    ordered = pdf.sort_values(["own", "node"], ascending=[False, True])
    return ordered, int(ordered["own"].sum())


def _listed(alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = _parted(pdf)
        if not n:
            return pd.DataFrame({"node": [], "list": []})
        nodes, unit = pdf["node"].to_numpy(), _unit(pdf["embedding"])
        lists = prune(distances(unit[:n], unit[n:]), alpha)
        return pd.DataFrame({"node": nodes[:n], "list": [nodes[own] for own in lists]})

    return run


def _searched(threshold: float):
    reach = 2 * np.sqrt(2 - 2 * threshold) + LOOSE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = _parted(pdf)
        if not n:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        unit = _unit(pdf["embedding"])
        nodes, weight, home = (pdf[c].to_numpy() for c in ("node", "m", "home"))
        part, block = int(pdf["part"].iloc[0]), int(pdf["with"].iloc[0])
        order = np.argsort(nodes)
        lists = []
        for united in pdf["list"].iloc[:n]:  # of the united list what is in this shard
            place = np.searchsorted(nodes, united, sorter=order)
            place = order[np.minimum(place, len(order) - 1)]
            lists.append(place[nodes[place] == united])
        start, a, b = medoid(unit[:n]), [], []
        for at in range(n):
            met, _ = search(unit, lists, start, at, reach)
            if part != block:
                met = met[met >= n]  # pairs within the part count where it is with itself
            met = met[np.einsum("ij,j->i", unit[met], unit[at]) >= threshold]
            a.append(np.full(len(met), at))
            b.append(met)
        a, b = np.concatenate(a).astype(int), np.concatenate(b).astype(int)
        links = np.bincount(a, weight[b], len(unit)).astype("i8")
        found = ~home[b]
        links += np.bincount(b[found], weight[a[found]], len(unit)).astype("i8")
        root = nodes.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, low[a])
            if (low == root).all():
                break
            root = low
        told = np.unique(np.concatenate([a, b]))
        return pd.DataFrame({"node": nodes[told], "links": links[told], "root": root[told]}).astype("int64")

    return run


def _sharded(classes: DataFrame, pivots: dict, cap: int, threshold: float) -> DataFrame:
    """Each class once for each shard it is in: columns of GROUP, node, m, embedding, home, own (of the shard's part)."""
    assigned = materialize(_assigned(classes, pivots, threshold), "vector-clusters")
    cluster = [*SPACE, "cluster"]
    sizes = assigned.groupBy(*cluster).agg(F.count("*").alias("size"), F.sum(F.col("home").cast("long")).alias("lived"))
    # blocks 0 to parts - 1 are the parts of those at home, the others are blocks of visitors
    sizes = sizes.filter("lived > 0 AND size > 1").select(
        *cluster, F.ceil(F.col("lived") / cap).cast("int").alias("parts"), F.ceil((F.col("size") - F.col("lived")) / cap).cast("int").alias("guests")
    )
    place = F.pmod(F.xxhash64(F.lit(1), "node"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("guests"))).cast("int")
    placed = assigned.join(sizes, cluster).withColumn("block", place + F.when(F.col("home"), 0).otherwise(F.col("parts")))
    columns = ["node", "m", "embedding", "home"]
    every = F.sequence(F.lit(0), F.col("parts") + F.col("guests") - 1)
    own = placed.filter("home").select(*cluster, F.col("block").alias("part"), F.explode(every).alias("with"), *columns, F.lit(True).alias("own"))
    parts = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("block"))
    others = placed.select(*cluster, F.explode(parts).alias("part"), F.col("block").alias("with"), *columns, F.lit(False).alias("own"))
    return own.unionByName(others)


def _found(classes: DataFrame, pivots: dict, cap: int, threshold: float, alpha: float) -> DataFrame:
    """Rows (node, links, root): parts of a class's number of linked vectors, and edges to a smaller one."""
    sharded = _sharded(classes, pivots, cap, threshold)
    lists = sharded.select(*GROUP, "node", "embedding", "own").groupBy(*GROUP).applyInPandas(_listed(alpha), "node long, list array<long>")
    united = materialize(
        lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list")), "vector-graph"
    )
    full = sharded.join(united, "node", "left").withColumn("list", F.when(F.col("own"), F.col("list")))
    return full.groupBy(*GROUP).applyInPandas(_searched(threshold), "node long, links long, root long")


def _audit(classes: DataFrame, found: DataFrame, threshold: float) -> float | None:
    """Mean recall, against brute force over all, of sampled classes that have links; None without any."""
    size, total = AUDIT, classes.count()
    while True:
        true = _true_links(classes, size, threshold)
        if sum(true.values()) >= AUDIT_LINKS or size >= min(AUDIT_MOST, total):
            break
        size = AUDIT_MOST
    linked = {n: links for n, links in true.items() if links}
    if not linked:
        return None
    ids = classes.sparkSession.createDataFrame([(n,) for n in linked], "node long")
    got = {r.node: r.links for r in found.join(ids, "node").groupBy("node").agg(F.sum("links").alias("links")).collect()}
    return float(np.mean([got.get(n, 0) / links for n, links in linked.items()]))


def _true_links(classes: DataFrame, size: int, threshold: float) -> dict[int, int]:
    """Links of ``size`` sampled classes to vectors of other classes, by brute force."""
    some = classes.orderBy(F.xxhash64(F.lit(11), "node"), "node").limit(size).select("node", *SPACE, "embedding").collect()
    spaces: dict = {}
    for row in some:
        spaces.setdefault((row.label, row.dim), []).append((row.node, row.embedding))
    shared = classes.sparkSession.sparkContext.broadcast(
        {space: (np.array([n for n, _ in rows]), _unit([v for _, v in rows])) for space, rows in spaces.items()}
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                pdf = batch.slice(begin, SLICE).to_pandas()
                for space, rows in pdf.groupby(SPACE):
                    if tuple(space) in shared.value:
                        ids, asked = shared.value[tuple(space)]
                        hits = _unit(rows["embedding"]) @ asked.T >= threshold
                        hits &= rows["node"].to_numpy()[:, None] != ids
                        totals[tuple(space)] = totals.get(tuple(space), 0) + rows["m"].to_numpy() @ hits
        for space, links in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[space][0]), pa.array(links, pa.int64())], ["node", "n"])

    counted = classes.select("node", "m", *SPACE, "embedding").mapInArrow(count, "node long, n long")
    return {r.node: r.n for r in counted.groupBy("node").agg(F.sum("n").alias("n")).collect()}


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = 0.98, target: int = 500, cap: int = 1024, alpha: float = 1.0,
) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept, audit_recall: one row per row of ``vectors``. ``target``: vectors
    wanted at home in a cluster; ``alpha``: 1 for the shortest lists, more for longer ones and shorter walks."""
    if alpha < 1:
        raise ValueError("alpha must be 1 or more")
    rows, classes = _classes(vectors, vec_id, embedding, label)
    classes = materialize(classes, "vector-classes")
    pivots = _pivots(classes, target, threshold)
    found = materialize(_found(classes, pivots, cap, threshold, alpha), "vector-links")
    reached = _audit(classes, found, threshold)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found, "node", "root").withColumnRenamed("component", "low")
    known = classes.join(links, "node", "left").join(joined, "node", "left").select(
        "node", "label", "embedding", "m",
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("low", "node").alias("low"),
    )
    several = known.filter("m > 1").drop("node", "m")
    copies = rows.filter("able").join(several, ["label", "embedding"]).select("vec_id", "links", "low")
    single = known.filter("m = 1").select("node", "links", "low")
    alone = rows.filter("NOT able").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("low"))
    everyone = single.withColumnRenamed("node", "vec_id").unionByName(copies).unionByName(alone)
    return everyone.select(
        "vec_id", F.col("links").alias("n_links"), F.col("low").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("low"), F.lit(True)).alias("kept"), F.lit(reached).cast("double").alias("audit_recall"),
    )
