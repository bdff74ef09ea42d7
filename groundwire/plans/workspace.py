"""Shared folders for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one temporary folder per application where a local
    master has none."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="groundwire-")
    return _local_roots[context.applicationId]


def new_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    return f"{root or shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _hadoop_path(spark, path)
    return files.exists(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, folder = _hadoop_path(spark, path)
    files.delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``materialize`` for work that is done before the block ends: the folder goes with it. Nothing lazy that reads
    it may leave the block."""
    path = new_folder(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.parquet(path)
    finally:
        remove_folder(df.sparkSession, path)
