"""Vision detections: thresholded view per image and label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default confidence, labels and emotions kept per image.
DEFAULT_CONFIDENCE = 70.0
MAX_LABELS = 25
MAX_EMOTIONS = 3
LINE = "LINE"


def _threshold(min_confidence: Column) -> Column:
    return F.coalesce(F.when(min_confidence != 0, min_confidence), F.lit(DEFAULT_CONFIDENCE))


def vision_summary(detections: DataFrame) -> DataFrame:
    """One row per image, computed inside its own arrays: no explode, no shuffle.

    Labels and moderation labels below the threshold are dropped; labels are ranked by confidence
    and cut to the service limit, as are the emotions of a face.
    """
    limit = F.col("_limit")

    def rounded(item: Column) -> Column:
        return F.struct(item["name"].alias("name"), F.bround(item["confidence"], 2).alias("confidence"))

    ranked = F.array_sort(F.transform(
        F.filter("labels", lambda x: x["confidence"] >= limit),
        lambda x: F.struct((-x["confidence"]).alias("order"), x["name"].alias("name"),
                           x["confidence"].alias("confidence")),
    ))

    def emotions(face: Column) -> Column:
        strong = F.filter(face["emotions"], lambda e: F.coalesce(e["confidence"], F.lit(0.0)) >= limit)
        return F.slice(F.transform(strong, lambda e: e["type"]), 1, MAX_EMOTIONS)

    return detections.withColumn("_limit", _threshold(F.col("min_confidence"))).select(
        "image_id",
        F.transform(F.slice(ranked, 1, MAX_LABELS), rounded).alias("labels"),
        F.transform(F.filter("text", lambda t: t["type"] == LINE), lambda t: t["text"]).alias("text_lines"),
        F.coalesce(F.size("faces"), F.lit(0)).cast("bigint").alias("face_count"),
        F.transform("faces", lambda f: F.struct(
            F.bround(F.coalesce(f["confidence"], F.lit(0.0)), 2).alias("confidence"),
            emotions(f).alias("emotions"),
        )).alias("faces"),
        F.transform(F.filter("moderation", lambda x: x["confidence"] >= limit), rounded).alias("moderation"),
    )


def label_counts(summary: DataFrame) -> DataFrame:
    """Images and mean confidence per label; summed in whole hundredths, so in any order the same."""
    labels = summary.select("image_id", F.inline("labels"))
    hundredths = F.sum(F.round(F.col("confidence") * 100).cast("bigint"))
    return labels.groupBy("name").agg(
        F.count("*").alias("images"), (hundredths / F.count("*") / 100).alias("avg_confidence")
    )
