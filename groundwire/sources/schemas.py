"""Schemas of the nested inputs."""

from __future__ import annotations

from pyspark.sql import types as T

NOTIFICATION = T.StructType([
    T.StructField("Records", T.ArrayType(T.StructType([
        T.StructField("s3", T.StructType([
            T.StructField("bucket", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("object", T.StructType([T.StructField("key", T.StringType())])),
        ])),
    ]))),
])

NAMED_SCORE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
DETECTIONS = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("min_confidence", T.DoubleType()),
    T.StructField("labels", T.ArrayType(NAMED_SCORE)),
    T.StructField("text", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("type", T.StringType()),
    ]))),
    T.StructField("faces", T.ArrayType(T.StructType([
        T.StructField("confidence", T.DoubleType()),
        T.StructField("emotions", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]))),
    ]))),
    T.StructField("moderation", T.ArrayType(NAMED_SCORE)),
])
