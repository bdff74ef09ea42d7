"""Image bytes: stored objects and inline base64, format detection and the size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.config import MAX_IMAGE_BYTES
from groundwire.functions.text import strip

# Leading bytes per format; a RIFF file is webp only if WEBP follows early on.
PNG_MAGIC = "89504E470D0A1A0A"
JPEG_MAGIC = "FFD8FF"
GIF_MAGIC = ("474946383761", "474946383961")
RIFF_MAGIC = "52494646"
WEBP_MARK = "57454250"
DEFAULT_FORMAT = "jpeg"


def image_format(content: Column, declared: Column | None = None) -> Column:
    """Declared format if given, else by leading bytes, else the default."""
    head = F.hex(F.substring(content, 1, 16))
    # An even offset keeps the mark on a byte boundary of the hex text.
    mark_at = F.locate(WEBP_MARK, head)
    detected = (
        F.when(head.startswith(PNG_MAGIC), "png")
        .when(head.startswith(JPEG_MAGIC), "jpeg")
        .when(head.startswith(GIF_MAGIC[0]) | head.startswith(GIF_MAGIC[1]), "gif")
        .when(head.startswith(RIFF_MAGIC) & (mark_at > 0) & (mark_at % 2 == 1), "webp")
        .otherwise(DEFAULT_FORMAT)
    )
    if declared is None:
        return detected
    return F.when(F.coalesce(declared, F.lit("")) != "", declared).otherwise(detected)


def decode_inline(payload: Column) -> Column:
    """Bytes after the first comma of a data URL, or of the plain payload; null when undecodable."""
    comma = F.locate(",", payload)
    body = F.when(comma > 0, F.substring(payload, comma + 1, F.length(payload))).otherwise(payload)
    return F.try_to_binary(strip(body), F.lit("base64"))


def read_stored_images(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "content")


def resolve_images(images: DataFrame) -> DataFrame:
    """(image_id, content?, image_base64?, image_format?) to bytes, origin, format and limit check."""
    columns = images.columns
    stored = F.col("content") if "content" in columns else F.lit(None).cast("binary")
    inline = F.col("image_base64") if "image_base64" in columns else F.lit(None).cast("string")
    declared = F.col("image_format") if "image_format" in columns else None
    resolved = images.withColumn("_bytes", F.coalesce(stored, decode_inline(inline)))
    size = F.octet_length(F.col("_bytes")).cast("bigint")
    return resolved.select(
        "image_id",
        F.when(stored.isNotNull(), "stored").otherwise("inline").alias("origin"),
        image_format(F.col("_bytes"), declared).alias("format"),
        size.alias("bytes"),
        F.when(F.col("_bytes").isNull(), "undecodable")
        .when(size > MAX_IMAGE_BYTES, "too large")
        .otherwise("ok").alias("status"),
    )


def image_inventory(images: DataFrame) -> DataFrame:
    return resolve_images(images).groupBy("origin", "format", "status").agg(
        F.count("*").alias("images"), F.sum("bytes").alias("bytes")
    )
