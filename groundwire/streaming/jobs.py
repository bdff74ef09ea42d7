"""Structured Streaming jobs. Each reuses its batch transform and writes to a Parquet sink.

Sinks and checkpoints live in the shared folder of the cluster; the file sink with its checkpoint
writes each batch exactly once, so a restarted job neither loses nor repeats rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from groundwire.config import EngineConfig
from groundwire.operators.ingestion import job_metrics, version_rows
from groundwire.operators.operations import dashboard_rollup, period_index
from groundwire.operators.policy import pii_matches
from groundwire.operators.routing import bind_models, decide_tier, route_modality
from groundwire.plans.workspace import new_folder
from groundwire.sources.access_log import with_routes
from groundwire.sources.chunk_store import if_there
from groundwire.sources.documents import under_prefix

LATENESS = "10 minutes"


def file_stream(
    spark: SparkSession, path: str, like: DataFrame, pattern: str = "*.parquet", files: int | None = None
) -> DataFrame:
    """Stream over a Parquet file or folder, with the schema of a batch table.

    ``files`` bounds the files of one micro-batch, and with them its state updates and memory.
    """
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str, lateness: str = LATENESS) -> DataFrame:
    """Watermarks need a zoned timestamp. Windows align to UTC, so run streams in a UTC session."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def run_to_parquet(stream: DataFrame, name: str, output: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything available, then stop; returns the sink folder.

    Pass ``output`` and ``checkpoint`` of an earlier run to continue it.
    """
    spark = stream.sparkSession
    sink = output or new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint or new_folder(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sink


def stream_ingest(
    objects: DataFrame, embedder: PipelineModel | Callable[[DataFrame], DataFrame] | None = None,
    prefix: str = "knowledge/",
) -> DataFrame:
    """Object stream (uri, key, text, version) to embedded rows of the chunk store.

    Nothing is dropped and nothing remembered: readers of the store take each document's newest version, so
    repeats change nothing, updates replace and late objects count as what they are.
    """
    return version_rows(under_prefix(objects, prefix), embedder).withColumn("ingested_at", F.current_timestamp())


def ingest_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per micro-batch that stored documents: job (from 1), started, documents, chunks, tokens, status.

    A batch has one time, which is kept when it is run again, and all its rows carry it; so the ledger is in what
    the sink has committed, however many batches there were. None before the first batch.
    """
    rows = if_there(spark.read.parquet, f"{path}/stream")
    if rows is None:
        return None
    batches = rows.groupBy(F.col("ingested_at").alias("started")).agg(*job_metrics())
    place = Window.orderBy("started")  # over the few rows of the ledger
    return batches.select(F.row_number().over(place).cast("long").alias("job"), "*", F.lit("COMPLETE").alias("status"))


def run_ingest(rows: DataFrame, path: str, checkpoint: str) -> DataFrame | None:
    """Store everything available of ``stream_ingest`` below ``path``; returns the ledger's rows of this run."""
    spark = rows.sparkSession
    held = ingest_ledger(spark, path)
    before = held.agg(F.max("started")).first()[0] if held is not None else None
    query = (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("bucket")
        .option("path", f"{path}/stream").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = ingest_ledger(spark, path)
    return done if before is None or done is None else done.filter(F.col("started") > F.lit(before))


def stream_ingest_jobs(objects: DataFrame, interval: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """Closed trigger intervals: uploads, the one job started, and triggers that met a running job."""
    arriving = event_time(objects, "ts", lateness)
    windows = arriving.groupBy(F.window("ts", interval).alias("_w")).agg(F.count("*").alias("uploaded"))
    return windows.select(
        F.col("_w.start").alias("period"), "uploaded", F.lit(1).cast("bigint").alias("started"),
        (F.col("uploaded") - 1).alias("conflicts"),
    )


def stream_error_counts(log: DataFrame, period: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Closed windows of the dashboard rollup."""
    return dashboard_rollup(event_time(with_routes(log), "ts", lateness), period)


def stream_latency_p99(
    log: DataFrame, period: str = "5 minutes", share: float = 0.99, lateness: str = LATENESS
) -> DataFrame:
    """Closed windows with the exact interpolated percentile.

    The aggregate keeps one counter per distinct millisecond value, combined before the shuffle, so
    its state is bounded by the service timeout and not by the number of calls.
    """
    timed = event_time(log, "ts", lateness)
    return timed.groupBy(F.window("ts", period).alias("_w")).agg(
        F.round(F.percentile("latency_ms", share), 4).alias("value"), F.count("*").alias("calls")
    ).select(F.col("_w.start").alias("period"), "value", "calls")


def stream_pii_scan(objects: DataFrame) -> DataFrame:
    """Findings of objects not scanned before: the checkpoint remembers the files of earlier runs."""
    return pii_matches(objects)


def stream_route(requests: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Modality, tier and model per arriving request; stateless."""
    routed = bind_models(decide_tier(route_modality(requests), config), config)
    return routed.select("request_id", "modality", "suggest_retrieval", "decision.*", "model_id")


def running_tier_counts(routed: DataFrame) -> DataFrame:
    """Running counts per tier and source, for a sink in complete or update mode."""
    return routed.groupBy("tier", "source").agg(F.count("*").alias("requests"))


EDGES = "alarm string, period_index long, state string, run long"
PENDING = "numbers array<long>, breaching array<boolean>, last long, run long, on boolean"


def edge_walk(periods: int):
    """From windows in order to state changes. State: the number of the last breach, the length of its run, and
    whether the alarm is on."""
    def walk(windows, last, run, on):
        edges = []
        for number, breaching in windows:
            follows = breaching and run and number == last + 1
            if not follows:
                if on:
                    edges.append((last + 1, "OK", run))
                run, on = 0, False
            if breaching:
                last, run = number, run + 1
                if run == periods:
                    edges.append((number, "ALARM", run))
                    on = True
        return edges, last, run, on

    return walk


def stream_alarm_edges(
    series: DataFrame, period_seconds: int, threshold: float, periods: int, lateness: str = LATENESS
) -> DataFrame:
    """State changes of a stream of closed windows (alarm, period, value), as ``alarm_edges`` gives them for a table:
    (alarm, period_index, state, run), appended as soon as the watermark has passed the window that decides them.

    Windows may arrive in any order within ``lateness``: an alarm's state keeps those that the watermark has not
    passed yet, and a timer in event time comes back for them. What it keeps besides is three values.
    """
    ends = F.col("period").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(period_seconds)))
    arriving = series.select(
        F.col("alarm"), period_index(F.col("period"), period_seconds).alias("number"), ends.alias("closed_at"),
        F.coalesce(F.col("value") >= threshold, F.lit(False)).alias("breaching"),
    ).withWatermark("closed_at", lateness)
    walk = edge_walk(periods)

    def step(key, parts, state):
        held = dict(zip(*state.get[:2])) if state.exists else {}
        last, run, on = state.get[2:] if state.exists else (0, 0, False)
        for part in parts:
            for number, breaching in zip(part["number"].tolist(), part["breaching"].tolist()):
                held[number] = held.get(number, False) or breaching
        mark = state.getCurrentWatermarkMs()
        passed = sorted(n for n in held if (n + 1) * period_seconds * 1000 <= mark)
        edges, last, run, on = walk([(n, held.pop(n)) for n in passed], last, run, on)
        numbers = sorted(held)
        state.update((numbers, [held[n] for n in numbers], last, run, on))
        if numbers:
            state.setTimeoutTimestamp(max((numbers[0] + 1) * period_seconds * 1000, mark + 1))
        yield pd.DataFrame([(key[0], *edge) for edge in edges], columns=["alarm", "period_index", "state", "run"])

    return arriving.groupBy("alarm").applyInPandasWithState(step, EDGES, PENDING, "append", GroupStateTimeout.EventTimeTimeout)


def tier_counts(routed: DataFrame) -> DataFrame:
    """How many requests each task of a batch routed to a tier, and why: (tier, source, requests). Stateless, so a
    stream appends them to a Parquet sink, each batch once, and ``stored_tier_counts`` adds them up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            total.update(zip(*(batch.column(c).to_pylist() for c in ("tier", "source"))))
        if total:
            tiers, sources = zip(*total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tiers, pa.string()), pa.array(sources, pa.string()), pa.array(list(total.values()), pa.int64())],
                ["tier", "source", "requests"],
            )

    return routed.select("tier", "source").mapInArrow(count, "tier string, source string, requests long")


def stored_tier_counts(spark: SparkSession, path: str) -> DataFrame:
    """Running counts per tier and source: of all that the sink below ``path`` has committed."""
    return spark.read.parquet(path).groupBy("tier", "source").agg(F.sum("requests").alias("requests"))
