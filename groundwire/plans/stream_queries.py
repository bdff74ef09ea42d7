"""Streaming jobs run over the whole tables until nothing is left, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import operations, policy
from groundwire.plans import oracle_views as v
from groundwire.plans.operation_queries import LATENCY_MS, alarm_sql
from groundwire.plans.policy_queries import FINDINGS_SQL
from groundwire.plans.registry import register
from groundwire.plans.routing_queries import CONFIG
from groundwire.plans.workspace import new_folder
from groundwire.sources import adapters, chunk_store
from groundwire.streaming import jobs


def table_stream(spark, sf_dir, name):
    """A table is one file or a folder of files; a glob that matches its name alone fits both."""
    path = f"{sf_dir}/{name}.parquet"
    return jobs.file_stream(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path))


def collected(spark, stream, name):
    return spark.read.parquet(jobs.run_to_parquet(stream, name))


def plain_time(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_INGESTED = f"""{v.KNOWLEDGE}, selected AS (
  SELECT uri, text || CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN ' revised' ELSE '' END AS text
  FROM knowledge_documents WHERE starts_with(key, 'knowledge/')){v.chunks('selected')}"""


def object_stream(spark, sf_dir):
    """Notifications of all documents as at least three micro-batches: everything but German documents; the
    labelled ones again; their revised texts; then, late, German documents and old versions of the labelled."""
    objects = adapters.knowledge_documents(spark, sf_dir).withColumn("version", F.col("ts").cast("timestamp"))
    lang = adapters.table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "de").alias("late"))
    known = adapters.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("revised")).distinct()
    marked = objects.join(lang, "doc_id").join(known, "doc_id", "left")
    later = F.col("version") + F.expr("INTERVAL 5 MINUTES")
    earlier = F.col("version") - F.expr("INTERVAL 300 DAYS")
    revised = marked.filter("revised").withColumns({"text": F.concat("text", F.lit(" revised")), "version": later})
    path = new_folder(spark, "objects")
    arrivals = (
        marked.filter("NOT late"), marked.filter("revised AND NOT late"), revised,
        marked.filter("late").unionByName(marked.filter("revised").withColumns({"text": F.lit("outdated"), "version": earlier})),
    )
    for rows in arrivals:
        rows.select("uri", "key", "text", "version").repartition(2).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, spark.read.parquet(path), files=2)


@register("stream_ingest", f"WITH {_INGESTED} SELECT chunk_id, uri, ordinal, text, n_tokens FROM chunks")
def stream_ingest(spark, sf_dir):
    path = new_folder(spark, "stream-index")
    rows = jobs.stream_ingest(object_stream(spark, sf_dir), letter_embedder)
    jobs.run_ingest(rows, path, new_folder(spark, "stream-index-checkpoint"))
    stored = chunk_store.read_chunks(spark, path)
    return stored.filter(F.col("embedding").isNotNull()).select("chunk_id", "uri", "ordinal", "text", "n_tokens")


@register("stream_ingest_jobs", f"""WITH {v.JOBS}
  SELECT * FROM jobs WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) FROM knowledge_documents) - INTERVAL 10 MINUTE""")
def stream_ingest_jobs(spark, sf_dir):
    arriving = adapters.knowledge_documents_of(table_stream(spark, sf_dir, "documents"))
    done = collected(spark, jobs.stream_ingest_jobs(arriving, "1 day"), "stream-ingest-jobs")
    return plain_time(done, "period")


def _closed(seconds: int) -> str:
    return f"period + INTERVAL {seconds} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def error_windows(spark, sf_dir):
    log = adapters.access_log_of(table_stream(spark, sf_dir, "events"))
    return jobs.run_to_parquet(jobs.stream_error_counts(log), "stream-errors")


def latency_windows(spark, sf_dir):
    log = adapters.access_log_of(table_stream(spark, sf_dir, "events"))
    return jobs.run_to_parquet(jobs.stream_latency_p99(log), "stream-latency")


@register("stream_error_alarm", f"WITH {v.DASHBOARD} SELECT * FROM dashboard WHERE {_closed(60)}")
def stream_error_alarm(spark, sf_dir):
    return plain_time(spark.read.parquet(error_windows(spark, sf_dir)), "period")


@register("stream_latency_p99", f"WITH {v.LATENCY} SELECT * FROM latency WHERE {_closed(300)}")
def stream_latency_p99(spark, sf_dir):
    return plain_time(spark.read.parquet(latency_windows(spark, sf_dir)), "period")


def _edges_sql(series: str, seconds: int, threshold: int, periods: int) -> str:
    index = f"CAST(floor(epoch({{}}) / {seconds}) AS BIGINT)"
    return f"""{alarm_sql(series, seconds, threshold, periods, _closed(seconds))}
  SELECT alarm, {index.format('alarm_from')} AS period_index, 'ALARM' AS state, CAST({periods} AS BIGINT) AS run FROM alarms
  UNION ALL SELECT alarm, {index.format('alarm_to')}, 'OK', breaching FROM alarms a
    WHERE EXISTS (SELECT 1 FROM {series} s WHERE s.alarm = a.alarm AND s.period >= a.alarm_to AND {_closed(seconds)})"""


@register("stream_alarm_edges_errors", f"WITH {v.ERROR_SERIES}{_edges_sql('series', 60, 1, 1)}")
def stream_alarm_edges_errors(spark, sf_dir):
    """The edges of the closed windows that the stream wrote."""
    windows = error_windows(spark, sf_dir)
    series = operations.error_series(spark.read.parquet(windows))
    return operations.alarm_edges(series, 60, operations.ERROR_THRESHOLD, operations.ERROR_PERIODS)


@register("stream_alarm_edges_latency", f"""WITH {v.LATENCY},
  latency_series AS (SELECT 'QueryDurationP99' AS alarm, * FROM latency){_edges_sql('latency_series', 300, LATENCY_MS, 2)}""")
def stream_alarm_edges_latency(spark, sf_dir):
    windows = latency_windows(spark, sf_dir)
    series = spark.read.parquet(windows).withColumn("alarm", F.lit("QueryDurationP99"))
    return operations.alarm_edges(series, 300, LATENCY_MS, operations.LATENCY_PERIODS)


def _settled(series: str, seconds: int) -> str:
    """Windows that the watermark of the closed windows has passed."""
    return f"{_closed(seconds)} AND period <= (SELECT max(period) FROM {series} WHERE {_closed(seconds)}) - INTERVAL 10 MINUTE"


def _stream_edges_sql(series: str, seconds: int, threshold: int, periods: int) -> str:
    """As the table's edges, of settled windows only."""
    index = f"CAST(floor(epoch({{}}) / {seconds}) AS BIGINT)"
    return f""", settled AS (SELECT * FROM {series} WHERE {_settled(series, seconds)}){alarm_sql('settled', seconds, threshold, periods)}
  SELECT alarm, {index.format('alarm_from')} AS period_index, 'ALARM' AS state, CAST({periods} AS BIGINT) AS run FROM alarms
  UNION ALL SELECT alarm, {index.format('alarm_to')}, 'OK', breaching FROM alarms a
    WHERE EXISTS (SELECT 1 FROM settled s WHERE s.alarm = a.alarm AND s.period >= a.alarm_to)"""


def window_stream(spark, windows):
    """The table of closed windows that another stream has written, as a stream."""
    return jobs.file_stream(spark, windows, spark.read.parquet(windows))


@register("stream_edges_errors", f"WITH {v.ERROR_SERIES}{_stream_edges_sql('series', 60, 1, 1)}")
def stream_edges_errors(spark, sf_dir):
    """Edges appended by a stream over the closed windows."""
    series = operations.error_series(window_stream(spark, error_windows(spark, sf_dir)))
    edges = jobs.stream_alarm_edges(series, 60, operations.ERROR_THRESHOLD, operations.ERROR_PERIODS)
    return collected(spark, edges, "edges-errors")


@register("stream_edges_latency", f"""WITH {v.LATENCY},
  latency_series AS (SELECT 'QueryDurationP99' AS alarm, * FROM latency){_stream_edges_sql('latency_series', 300, LATENCY_MS, 2)}""")
def stream_edges_latency(spark, sf_dir):
    series = window_stream(spark, latency_windows(spark, sf_dir)).withColumn("alarm", F.lit("QueryDurationP99"))
    edges = jobs.stream_alarm_edges(series, 300, LATENCY_MS, operations.LATENCY_PERIODS)
    return collected(spark, edges, "edges-latency")


@register("stream_pii_scan", FINDINGS_SQL)
def stream_pii_scan(spark, sf_dir):
    """Both buckets as streams; their findings are summarised after the run."""
    documents = table_stream(spark, sf_dir, "documents").select(
        F.lit("documents").alias("bucket"), F.col("doc_id").cast("string").alias("object_id"), "text"
    )
    pages = table_stream(spark, sf_dir, "pages").select(
        F.lit("uploads").alias("bucket"), F.col("page_id").cast("string").alias("object_id"), F.col("html").alias("text")
    )
    found = collected(spark, jobs.stream_pii_scan(documents.unionByName(pages)), "stream-pii")
    return policy.summarize_findings(found)


_ROUTED = v.CLASSIFIED + f""",
routed AS (SELECT request_id, CASE WHEN has_image AND {v.strip('query')} <> '' THEN 'multimodal' WHEN has_image THEN 'image' ELSE 'text' END AS modality,
  coalesce(override_tier, tier) AS tier, CASE WHEN override_tier IS NULL THEN source ELSE 'override' END AS source FROM classified)"""


@register("stream_route", f"""WITH {_ROUTED}
  SELECT request_id, modality, tier, source, CASE tier WHEN 'fast' THEN {v.lit(CONFIG.fast_model_id)}
    ELSE {v.lit(CONFIG.reasoning_model_id)} END AS model_id FROM routed""")
def stream_route(spark, sf_dir):
    arriving = adapters.requests_of(table_stream(spark, sf_dir, "conversations"))
    return collected(spark, jobs.stream_route(arriving), "stream-route").select(
        "request_id", "modality", "tier", "source", "model_id"
    )


@register("stream_tier_counts", f"WITH {_ROUTED} SELECT tier, source, count(*) AS requests FROM routed GROUP BY 1, 2")
def stream_tier_counts(spark, sf_dir):
    arriving = adapters.requests_of(table_stream(spark, sf_dir, "conversations"))
    sink = jobs.run_to_parquet(jobs.tier_counts(jobs.stream_route(arriving)), "tier-counts")
    return jobs.stored_tier_counts(spark, sink)
