"""Chunk table of a knowledge index: append-only rows, the newest version of a document counts.

Every ingested document version is one header row (ordinal -1) and its chunk rows, all with the hash of its
content. Readers take the newest header of each document and the chunks with its content, so a changed
document replaces its chunks, an older version that arrives late replaces nothing, and writing the same version
twice changes nothing. Rows are partitioned by a hash of the document, and an ingest compares itself with the
headers of the partitions it touches, never with the texts or ids of the store. A null version is older than
every other: it is stored for a new document and changes nothing of a known one. A document needs a uri; rows
without one are no documents and are not stored.

``merge_versions`` folds what was appended since the last merge into a snapshot: the headers and chunks of the
newest versions only, partition by partition, those without news left where they are. A manifest, one file that
appears at once, names the folder of each partition and the appended files that are in it. Readers take the newest
manifest and the appended files it does not name, so they see the same rows before, during and after a merge, and
a merge that dies leaves nothing that anybody reads. Files are only ever added.

Texts move once for an ingest and once for a merge: they are dealt by bucket and a share of it, joined with the
versions there, and written where they are. A read beside a snapshot moves only those buckets in which a document
was replaced, as the headers tell.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
HEADER = -1
#: Rows of batch ingests and of streams; a stream's sink shows only what its own log has committed.
FOLDERS = ("rows", "stream")
KEY = ["bucket", "uri", "content"]
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def bucket_of(uri: Column) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(BUCKETS)).cast("int")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` by bucket and ``share`` of the bucket, a hash of ``key`` other than that of the bucket. Two sides dealt
    alike are joined by these columns and more, deduplicated and, by ``write_dealt``, written by bucket without another
    shuffle; a task has about four shares, and each share is one file."""
    shares = -(-4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    return rows.withColumn("share", F.pmod(F.hash(*key), F.lit(shares))).repartition("bucket", "share")


def write_dealt(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write rows that are dealt by bucket. Spark otherwise deals both sides of a join anew by all its keys, and then
    every task has rows of every bucket."""
    settings = rows.sparkSession.conf
    before = settings.get(CO_PARTITION)
    settings.set(CO_PARTITION, "false")
    try:
        rows.write.mode(mode).partitionBy("bucket").parquet(path)
    finally:
        settings.set(CO_PARTITION, before)


def content_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def if_there(read, *args) -> DataFrame | None:
    """What ``read`` gives, or None where nothing has been written yet."""
    try:
        return read(*args)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _union(parts: list[DataFrame]) -> DataFrame | None:
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


@dataclass
class Manifest:
    """``folders``: the snapshot folder of each bucket; ``merged``: the appended files that are in it."""

    number: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    merged: list[str] = field(default_factory=list)


def newest_manifest(spark: SparkSession, path: str) -> Manifest:
    """The state readers start from; an empty one for a store without a merge. The driver holds the names of the
    files, as it does to read them."""
    written = if_there(spark.read.parquet, f"{path}/manifest")
    if written is None:
        return Manifest()
    number = written.agg(F.max("number")).first()[0]
    rows = written.filter(F.col("number") == number).select("bucket", "name").collect()
    return Manifest(
        number, {r.bucket: r.name for r in rows if r.bucket is not None}, [r.name for r in rows if r.bucket is None]
    )


def appended_rows(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame | None:
    """Rows that no merge has taken up, with the column ``file``; merged files are not opened."""
    reader = spark.read.option("mergeSchema", "true")
    parts = [if_there(reader.parquet, f"{path}/{folder}") for folder in FOLDERS]
    return _union([
        part.select("*", F.col("_metadata.file_path").alias("file")).filter(~F.col("_metadata.file_path").isin(manifest.merged))
        for part in parts if part is not None
    ])


def snapshot_rows(spark: SparkSession, manifest: Manifest, kind: str) -> DataFrame | None:
    """``kind``: headers (bucket, uri, version, content) or chunks of the newest merged versions."""
    held: dict[str, list[int]] = {}
    for bucket, folder in manifest.folders.items():
        held.setdefault(folder, []).append(bucket)
    parts = [(if_there(spark.read.parquet, f"{folder}/{kind}"), buckets) for folder, buckets in held.items()]
    return _union([part.filter(F.col("bucket").isin(buckets)) for part, buckets in parts if part is not None])


def newest_versions(rows: DataFrame) -> DataFrame:
    """One row (bucket, uri, version, content) per document."""
    newest = rows.filter(F.col("ordinal") == HEADER).groupBy("bucket", "uri").agg(
        F.max(F.struct("version", "content")).alias("_newest")
    )
    return newest.select("bucket", "uri", "_newest.version", "_newest.content")


class Store:
    """A store as one reader sees it: the newest manifest, and the files that were there when it was opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.manifest = newest_manifest(spark, path)
        self.appended = appended_rows(spark, path, self.manifest)
        self.headers = snapshot_rows(spark, self.manifest, "headers")
        self.merged = snapshot_rows(spark, self.manifest, "chunks")

    @property
    def empty(self) -> bool:
        return self.appended is None and self.headers is None

    def versions(self, buckets: list[int] | None = None) -> DataFrame:
        """One row (bucket, uri, version, content) per document, from headers alone."""
        fresh, held = self.appended, self.headers
        if buckets is not None:
            fresh = fresh if fresh is None else fresh.filter(F.col("bucket").isin(buckets))
            held = held if held is None else held.filter(F.col("bucket").isin(buckets))
        if held is None:
            return newest_versions(fresh)
        if fresh is None:
            return held.select("bucket", "uri", "version", "content")
        both = held.withColumn("ordinal", F.lit(HEADER)).unionByName(fresh, allowMissingColumns=True)
        return newest_versions(both)

    def chunks(self) -> DataFrame:
        """Chunk rows of every document's newest version with ``bucket`` and ``content``, each once. Only what was
        appended since the last merge is compared and deduplicated, and of the snapshot only buckets in which a
        document was replaced; the others are read as they lie. Rows that are compared come dealt by bucket."""
        if self.appended is None:
            return self.headers.select("bucket", "content").limit(0) if self.merged is None else self.merged
        if self.headers is None:
            return self._newest_chunks(newest_versions(self.appended).select(*KEY))
        news = self.replaced()
        buckets = [r.bucket for r in news.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if self.merged is None:  # a snapshot of blank documents
            return self._newest_chunks(news)
        if not buckets:
            return self.merged
        within = F.col("bucket").isin(buckets)
        # no semi and anti joins: Spark moves them below the dealing, and the rows are shuffled twice
        gone = dealt(news.select("bucket", "uri", F.lit(True).alias("_gone")), "uri")
        kept = dealt(self.merged.filter(within), "uri").join(gone, ["bucket", "share", "uri"], "left")
        kept = kept.filter(F.col("_gone").isNull()).drop("_gone", "share")
        return _union([self.merged.filter(~within), kept, self._newest_chunks(news, buckets)])

    def _newest_chunks(self, newest: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Appended chunk rows of the versions ``newest`` (KEY, one row a document), each once."""
        fresh = self.appended.filter(F.col("ordinal") != HEADER).drop("version", "file")
        fresh = fresh if buckets is None else fresh.filter(F.col("bucket").isin(buckets))
        place = [*KEY, "share"]
        held = dealt(fresh, "uri", "content").join(dealt(newest, "uri", "content"), place)
        return held.dropDuplicates([*place, "chunk_id"]).drop("share")

    def replaced(self) -> DataFrame:
        """Documents whose newest version is an appended one and says something else than the snapshot."""
        old = self.headers.select("bucket", "uri", F.struct("version", "content").alias("_old"))
        newest = newest_versions(self.appended).join(old, ["bucket", "uri"], "left")
        newer = F.struct("version", "content") > F.col("_old")
        return newest.filter(
            F.col("_old").isNull() | (newer & (F.col("content") != F.col("_old.content")))
        ).select(*KEY)


def read_chunks(spark: SparkSession, path: str, **columns: Column) -> DataFrame | None:
    """The chunks of every document's newest version, each once; None for a store that does not exist. ``columns`` are
    added where the rows lie: what is wanted of a vector is found there, and the vector itself need not move."""
    store = Store(spark, path)
    if store.empty:
        return None
    store.appended, store.merged = (rows if rows is None else rows.withColumns(columns) for rows in (store.appended, store.merged))
    return store.chunks().drop("bucket", "content")


def merge_versions(spark: SparkSession, path: str) -> int:
    """Fold appended rows into the snapshot; returns the number of the manifest that now holds. Of two merges at
    a time one fails when it writes its manifest, and the other counts."""
    store = Store(spark, path)
    news = [] if store.appended is None else store.appended.select("bucket", "file").distinct().collect()
    if not news:
        return store.manifest.number
    touched = sorted({r.bucket for r in news})
    folder = f"{path}/snapshots/{uuid.uuid4().hex}"
    headers = store.versions(touched).hint("rebalance", "bucket")
    for kind, rows in (("headers", headers), ("chunks", store.chunks().filter(F.col("bucket").isin(touched)))):
        write_dealt(rows, f"{folder}/{kind}")
    folders = store.manifest.folders | dict.fromkeys(touched, folder)
    files = store.manifest.merged + sorted({r.file for r in news})
    rows = [(b, f) for b, f in sorted(folders.items())] + [(None, f) for f in files]
    number = store.manifest.number + 1
    spark.createDataFrame(rows, "bucket int, name string").coalesce(1).write.parquet(f"{path}/manifest/number={number}")
    return number


def changed_documents(documents: DataFrame, path: str) -> DataFrame:
    """The newest version of each of ``documents`` (uri, text, version, ...) that the store lacks, with its bucket and
    content, dealt by bucket.

    ``content_known`` marks a version that is newer but says the same, which needs a header only;
    ``old_content`` is what the store holds of the document, null for a new one. Versions are compared by id,
    version and hash alone; texts are joined to what is left.
    """
    marked = documents.filter("uri IS NOT NULL").withColumns(
        {"content": content_of(F.col("text")), "bucket": bucket_of(F.col("uri"))}
    )
    newest = marked.groupBy("bucket", "uri").agg(F.max(F.struct("version", "content")).alias("_n")).select(
        "bucket", "uri", "_n.version", "_n.content"
    )
    store = Store(documents.sparkSession, path)
    if store.empty:
        wanted = newest.withColumns({"content_known": F.lit(False), "old_content": F.lit(None).cast("string")})
    else:
        touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        known = store.versions(touched).select(
            "bucket", "uri", F.col("version").alias("_version"), F.col("content").alias("old_content")
        )
        newer = F.struct("version", "content") > F.struct(F.col("_version").alias("version"), F.col("old_content").alias("content"))
        wanted = (
            newest.join(known, ["bucket", "uri"], "left").filter(F.col("old_content").isNull() | newer)
            .withColumn("content_known", F.coalesce(F.col("content") == F.col("old_content"), F.lit(False))).drop("_version")
        )
    place = [*KEY, "share"]
    joined = dealt(marked, "uri", "content").join(
        dealt(wanted.withColumnRenamed("version", "_v"), "uri", "content"), place
    )
    # equal rows of one version come down to one
    return joined.filter(F.col("version").eqNullSafe(F.col("_v"))).drop("_v").dropDuplicates(place).drop("share")


def append_rows(rows: DataFrame, path: str) -> None:
    """Add version rows, one file per bucket and task."""
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{FOLDERS[0]}")


def latest_chunks(chunks: DataFrame, version: str) -> DataFrame:
    """Newest row per chunk id; the rank filter is pushed below the shuffle, so copies collapse early."""
    order = Window.partitionBy("chunk_id").orderBy(F.col(version).desc())
    return chunks.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def stale_chunks(chunks: DataFrame, live_documents: DataFrame) -> DataFrame:
    """Chunks whose source document no longer exists."""
    return chunks.join(live_documents.select("uri").distinct(), "uri", "left_anti")
