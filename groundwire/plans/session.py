"""Session settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", *, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("groundwire")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    threads = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.groundwire.scanPartitions", str(threads))  # the test files can't be split
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
