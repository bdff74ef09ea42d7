"""Document store scan and object notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.sources.schemas import NOTIFICATION


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def read_documents(spark: SparkSession, path: str, prefix: str = "knowledge/") -> DataFrame:
    """Whole text files below ``path`` whose key starts with ``prefix``; the glob prunes the listing."""
    root = path.rstrip("/")
    folder = prefix.rstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", "true").text(f"{root}/{folder}", wholetext=True)
        if prefix.endswith("/")
        else spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    )
    # File paths come URL-encoded (a plus sign stands for itself); keys and URIs are as stored.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    qualified = spark._jvm.org.apache.hadoop.fs.Path(root if root.rpartition(":")[2].strip("/") else f"{root}/")
    system = qualified.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(qualified).toUri().getPath().rstrip("/") + "/"
    # Below the scheme and the bucket, a key is what follows the root.
    inside = F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    key = F.substring(inside, F.lit(len(base) + 1), F.length(inside))
    return files.select(
        uri.alias("uri"), key.alias("key"), F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).filter(F.col("key").startswith(prefix))


def under_prefix(objects: DataFrame, prefix: str = "knowledge/") -> DataFrame:
    return objects.filter(F.col("key").startswith(prefix))


def object_events(notifications: DataFrame, body: str = "body") -> DataFrame:
    """One row per notified object; records lacking a bucket or a key are dropped.

    Keys stay as sent (no URL decoding). Other columns are carried along.
    """
    others = [c for c in notifications.columns if c != body]
    record = F.explode(F.from_json(F.col(body), NOTIFICATION).getField("Records"))
    return (
        notifications.select(*others, record.alias("_r"))
        .select(
            *others,
            F.col("_r.s3.bucket.name").alias("bucket"),
            F.col("_r.s3.object.key").alias("key"),
        )
        .filter((F.col("bucket") != "") & (F.col("key") != ""))
        .withColumn("uri", object_uri(F.col("bucket"), F.col("key")))
    )


def count_objects(objects: DataFrame) -> DataFrame:
    return objects.groupBy("bucket").agg(F.count("*").alias("objects"))
