"""Object metadata lookup, the dated key layout and the audit trail scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content type by lower-case extension (the common part of the standard registry).
CONTENT_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html",
    "htm": "text/html", "xml": "text/xml", "json": "application/json", "pdf": "application/pdf",
    "doc": "application/msword", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "zip": "application/zip", "tar": "application/x-tar",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "tiff": "image/tiff", "bmp": "image/bmp",
    "mp3": "audio/mpeg", "mp4": "video/mp4",
}
# Suffixes that name a compression, not a type.
ENCODING_SUFFIX = r"(?i)\.(gz|bz2|xz|br|z)$"
FALLBACK_TYPE = "application/octet-stream"
# Key prefixes per purpose and the date stamp inside a key.
UPLOAD_PREFIX = "uploads/"
DATE_STAMP = "yyyy/MM/dd"


def lookup_objects(refs: DataFrame, inventory: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Metadata per (bucket, key) reference; buckets off the allow-list are errors and never joined."""
    permitted = F.col("bucket").isin(*allowed)
    details = inventory.filter(permitted).select(
        "bucket", "key", "content_type", "content_length", "sse", F.lit(True).alias("_found")
    )
    return refs.join(details, ["bucket", "key"], "left").withColumn(
        "status",
        F.when(~permitted, "bucket not allowed")
        .when(F.col("_found").isNull(), "not found")
        .otherwise("ok"),
    ).drop("_found")


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    safe = F.ltrim(F.replace(filename, F.lit(".."), F.lit("")), F.lit("/"))
    return F.when(
        safe.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(safe, ".", -1)))
    ).otherwise("")


def content_type(filename: Column, fallback: Column | str = FALLBACK_TYPE) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    name = F.regexp_replace(filename, ENCODING_SUFFIX, "")
    suffix = F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))
    return F.coalesce(
        F.try_element_at(table, suffix), fallback if isinstance(fallback, Column) else F.lit(fallback)
    )


def layout_objects(
    objects: DataFrame, *, purpose: Column, documents_prefix: str = "knowledge/",
    buckets: Mapping[str, str] | None = None,
) -> DataFrame:
    """Target bucket, dated key and content type of (object_id, filename, created) rows.

    The name inside the day is a hash of the object id, so a repeated run writes the same key.
    """
    names = buckets or {"document": "documents", "upload": "uploads"}
    is_document = purpose == "document"
    prefix = F.when(is_document, documents_prefix).otherwise(UPLOAD_PREFIX)
    key = F.concat(
        prefix, F.date_format("created", DATE_STAMP), F.lit("/"),
        F.sha2(F.col("object_id").cast("string"), 256), extension(F.col("filename")),
    )
    return objects.select(
        "*",
        F.when(is_document, names["document"]).otherwise(names["upload"]).alias("bucket"),
        key.alias("key"),
        content_type(F.col("filename")).alias("content_type"),
    )


def write_layout(objects: DataFrame, path: str, run: str) -> None:
    """Partition by run and day; the rebalance hint splits a day that is too large for one task.

    ``run`` names this write: repeating it replaces its own files and no others, so a job that is run again
    stores nothing twice. Different runs may hold the same object; ``read_layout`` returns it once.
    """
    dated = objects.withColumns({
        "year": F.date_format("created", "yyyy"),
        "month": F.date_format("created", "MM"),
        "day": F.date_format("created", "dd"),
    })
    (
        dated.hint("rebalance", "year", "month", "day")
        .write.mode("overwrite").partitionBy("year", "month", "day").parquet(f"{path}/run={run}")
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Every stored object once; a key is a hash of its object, so rows of one key are the same."""
    return spark.read.parquet(path).drop("run", "year", "month", "day").dropDuplicates(["bucket", "key"])


# Verbs that only read.
READ_VERBS = ("view", "click", "get", "head", "list", "describe")


def audit_events(events: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Management events (no bucket) plus data events on the given buckets, per bucket and verb."""
    is_management = F.col("bucket").isNull()
    kept = events.filter(is_management | F.col("bucket").isin(*buckets))
    return kept.groupBy(
        F.when(is_management, "management").otherwise("data").alias("event_class"),
        F.coalesce("bucket", F.lit("-")).alias("bucket"),
        F.col("verb"),
        F.when(F.lower("verb").isin(*READ_VERBS), "read").otherwise("write").alias("access"),
    ).agg(F.count("*").alias("events"))
