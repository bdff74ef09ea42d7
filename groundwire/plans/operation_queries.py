"""Access logs, alarms, budgets, quotas, retention and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.operators import operations
from groundwire.plans import oracle_views as v
from groundwire.plans.registry import register
from groundwire.plans.workspace import materialize
from groundwire.sources import access_log, adapters, objects

# The production quota never triggers on the small tables, so the query passes a lower one.
QUOTA = 60
AS_OF = "2024-04-01 00:00:00"


@register("access_log_scan", f"""WITH {v.ROUTED_LOG}
  SELECT route, service, outcome, count(*) AS calls FROM routed_log GROUP BY 1, 2, 3""")
def access_log_scan(spark, sf_dir):
    return access_log.access_log_scan(adapters.access_log(spark, sf_dir))


@register("audit_events", """WITH log AS (SELECT event_type AS verb, CASE WHEN event_type = 'signup' THEN NULL
    ELSE ['documents', 'uploads', 'logs', 'other'][CAST(user_id%4 AS INTEGER) + 1] END AS bucket FROM events)
  SELECT CASE WHEN bucket IS NULL THEN 'management' ELSE 'data' END AS event_class, coalesce(bucket, '-') AS bucket, verb,
    CASE WHEN verb IN ('view', 'click') THEN 'read' ELSE 'write' END AS access, count(*) AS events
  FROM log WHERE bucket IS NULL OR bucket IN ('documents', 'uploads') GROUP BY 1, 2, 3, 4""")
def audit_events(spark, sf_dir):
    return objects.audit_events(adapters.audit_log(spark, sf_dir), ("documents", "uploads"))


def routed_log(spark, sf_dir):
    return access_log.with_routes(adapters.access_log(spark, sf_dir))


@register("dashboard_rollup", f"WITH {v.DASHBOARD} SELECT * FROM dashboard")
def dashboard_rollup(spark, sf_dir):
    return operations.dashboard_rollup(routed_log(spark, sf_dir))


@register("latency_p99", f"WITH {v.LATENCY} SELECT * FROM latency")
def latency_p99(spark, sf_dir):
    return operations.latency_percentile(adapters.access_log(spark, sf_dir))


def alarm_sql(series: str, seconds: int, threshold: int, periods: int, closed: str = "true") -> str:
    """Spans of ``series`` by counting back over a dense period axis, unlike the operator's islands."""
    return f""",
breaches AS (SELECT alarm, period FROM {series} WHERE value >= {threshold} AND {closed}),
starts AS (SELECT alarm, period FROM breaches b WHERE NOT EXISTS (SELECT 1 FROM breaches p
  WHERE p.alarm = b.alarm AND p.period = b.period - INTERVAL {seconds} SECOND)),
ends AS (SELECT alarm, period FROM breaches b WHERE NOT EXISTS (SELECT 1 FROM breaches p
  WHERE p.alarm = b.alarm AND p.period = b.period + INTERVAL {seconds} SECOND)),
runs AS (SELECT s.alarm, s.period AS first_period, (SELECT min(e.period) FROM ends e WHERE e.alarm = s.alarm AND e.period >= s.period) AS last_period FROM starts s),
alarms AS (SELECT alarm, first_period + INTERVAL {seconds * (periods - 1)} SECOND AS alarm_from,
  last_period + INTERVAL {seconds} SECOND AS alarm_to, CAST(date_diff('second', first_period, last_period) / {seconds} + 1 AS BIGINT) AS breaching
  FROM runs WHERE date_diff('second', first_period, last_period) / {seconds} + 1 >= {periods})"""


@register("alarm_state_errors", f"WITH {v.ERROR_SERIES}{alarm_sql('series', 60, 1, 1)} SELECT * FROM alarms")
def alarm_state_errors(spark, sf_dir):
    series = operations.error_series(operations.dashboard_rollup(routed_log(spark, sf_dir)))
    return operations.alarm_periods(series, 60, operations.ERROR_THRESHOLD, operations.ERROR_PERIODS)


# Five-minute windows hold one or two calls here, so the threshold is a parameter too.
LATENCY_MS = 10_000
_LATENCY_SERIES = v.LATENCY + ", latency_series AS (SELECT 'QueryDurationP99' AS alarm, * FROM latency)"


@register("alarm_state_latency", f"""WITH {_LATENCY_SERIES}{alarm_sql('latency_series', 300, LATENCY_MS, 2)}
  SELECT * FROM alarms""")
def alarm_state_latency(spark, sf_dir):
    series = operations.latency_percentile(adapters.access_log(spark, sf_dir)).withColumn(
        "alarm", F.lit("QueryDurationP99")
    )
    return operations.alarm_periods(series, 300, LATENCY_MS, operations.LATENCY_PERIODS)


@register("budget_status", """WITH daily AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,6))) AS spend FROM events GROUP BY 1),
  running AS (SELECT *, CAST(sum(spend) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS DOUBLE) AS mtd FROM daily),
  forecasts AS (SELECT *, mtd / day(day) * day(last_day(day)) AS f FROM running)
  SELECT day, CAST(spend AS DOUBLE) AS spend, mtd AS month_to_date, f AS forecast,
    mtd > 150.0 * 0.8 AS actual_alert, f > 150.0 AS forecast_alert FROM forecasts""")
def budget_status(spark, sf_dir):
    return operations.budget_status(adapters.table(spark, sf_dir, "events").select("ts", F.col("value").alias("cost")))


@register("quota_usage", f"""WITH {v.ROUTED_LOG},
  numbered AS (SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY caller, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM access_log),
  seconds AS (SELECT caller, month, date_trunc('second', ts) AS s, count(*) AS n FROM numbered GROUP BY 1, 2, 3),
  busy AS (SELECT caller, month, count(*) FILTER (n > 1) AS burst_seconds, count(*) FILTER (n > 0) AS rate_seconds, max(n) AS peak_per_second FROM seconds GROUP BY 1, 2),
  totals AS (SELECT caller, month, count(*) AS calls FROM numbered GROUP BY 1, 2)
  SELECT caller, month, calls, burst_seconds, rate_seconds, peak_per_second, f.ts AS first_over_at, f.event_id AS first_over_event, calls > {QUOTA} AS over_quota
  FROM totals JOIN busy USING (caller, month) LEFT JOIN (SELECT caller, month, ts, event_id FROM numbered WHERE n = {QUOTA} + 1) f USING (caller, month)""")
def quota_usage(spark, sf_dir):
    return operations.quota_usage(adapters.access_log(spark, sf_dir), monthly=QUOTA, burst=1, rate=0)


_VERSIONS = v.OBJECTS + """,
versions AS (SELECT *, lead(created) OVER (PARTITION BY bucket, key ORDER BY created, version_id) AS noncurrent_since FROM objects)"""


@register("noncurrent_versions", f"WITH {_VERSIONS} SELECT bucket, key, version_id, created, noncurrent_since FROM versions")
def noncurrent_versions(spark, sf_dir):
    return operations.with_noncurrent_since(adapters.objects(spark, sf_dir)).select(
        "bucket", "key", "version_id", "created", "noncurrent_since"
    )


@register("retention_report", f"""WITH {_VERSIONS}, ruled AS (SELECT *, CASE
    WHEN bucket IN ('documents', 'uploads') AND state = 'incomplete' AND created <= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'incomplete upload'
    WHEN state = 'incomplete' THEN NULL
    WHEN bucket IN ('documents', 'uploads') AND noncurrent_since IS NOT NULL AND noncurrent_since <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'old version'
    WHEN noncurrent_since IS NULL AND bucket = 'uploads' AND created <= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 'upload age'
    WHEN noncurrent_since IS NULL AND bucket = 'logs' AND created <= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 'log age'
    WHEN noncurrent_since IS NULL AND bucket = 'log-groups' AND created <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'log group age' END AS rule FROM versions)
  SELECT bucket, rule, count(*) AS versions, CAST(sum(size) AS BIGINT) AS bytes, min(created) AS oldest FROM ruled WHERE rule IS NOT NULL GROUP BY 1, 2""")
def retention_report(spark, sf_dir):
    return operations.retention_report(operations.with_noncurrent_since(adapters.objects(spark, sf_dir)), AS_OF)


@register("ingestion_jobs", f"WITH {v.JOBS} SELECT *, CAST(0 AS BIGINT) AS not_configured FROM jobs")
def ingestion_jobs(spark, sf_dir):
    return operations.ingestion_jobs(adapters.knowledge_documents(spark, sf_dir), "1 day")


@register("ingestion_stats", f"""WITH {v.JOBS}
  SELECT 'uploaded' AS status, '-' AS reason, CAST(sum(uploaded) AS BIGINT) AS n FROM jobs
  UNION ALL SELECT 'started', '-', CAST(sum(started) AS BIGINT) FROM jobs
  UNION ALL SELECT 'skipped', 'ConflictException', CAST(sum(conflicts) AS BIGINT) FROM jobs""")
def ingestion_stats(spark, sf_dir):
    return operations.ingestion_stats(operations.ingestion_jobs(adapters.knowledge_documents(spark, sf_dir), "1 day"))


@register("ingestion_stats_off", """SELECT 'uploaded' AS status, '-' AS reason, count(*) AS n FROM documents
  UNION ALL SELECT 'skipped', 'ids not set', count(*) FROM documents""")
def ingestion_stats_off(spark, sf_dir):
    """Without a configured knowledge base every trigger is skipped."""
    jobs = operations.ingestion_jobs(adapters.knowledge_documents(spark, sf_dir), "1 day", configured=False)
    return operations.ingestion_stats(jobs)


#: Seconds an ingestion job runs.
JOB_SECONDS = 3 * 3600
_CHAIN = f"""WITH RECURSIVE {v.KNOWLEDGE},
  valid AS (SELECT ts FROM knowledge_documents WHERE starts_with(key, 'knowledge/')),
  chain AS (SELECT min(ts) AS started FROM valid
    UNION ALL SELECT (SELECT min(ts) FROM valid WHERE ts >= c.started + INTERVAL {JOB_SECONDS} SECOND) FROM chain c WHERE c.started IS NOT NULL),
  busy AS (SELECT c.started, count(*) AS uploaded, count(*) - 1 AS conflicts FROM chain c
    JOIN valid v ON v.ts >= c.started AND v.ts < c.started + INTERVAL {JOB_SECONDS} SECOND GROUP BY 1)"""


def triggers(spark, sf_dir):
    """One trigger per stored document; the service refuses those outside the knowledge prefix."""
    arrived = adapters.knowledge_documents(spark, sf_dir)
    return arrived.select("ts", F.col("key").startswith("knowledge/").alias("valid"))


@register("busy_jobs", f"{_CHAIN} SELECT * FROM busy")
def busy_jobs(spark, sf_dir):
    return operations.busy_jobs(triggers(spark, sf_dir), JOB_SECONDS)


@register("busy_job_stats", f"""{_CHAIN}
  SELECT 'uploaded' AS status, '-' AS reason, count(*) AS n FROM knowledge_documents
  UNION ALL SELECT 'started', '-', count(*) FROM busy
  UNION ALL SELECT 'skipped', 'ConflictException', CAST(sum(conflicts) AS BIGINT) FROM busy HAVING sum(conflicts) > 0
  UNION ALL SELECT 'skipped', 'ValidationException', count(*) FROM knowledge_documents WHERE NOT starts_with(key, 'knowledge/')
    HAVING count(*) > 0""")
def busy_job_stats(spark, sf_dir):
    return operations.busy_job_stats(triggers(spark, sf_dir), JOB_SECONDS)


_CROWDED = """crowded AS (SELECT CAST(user_id % 3 AS VARCHAR) AS caller,
    date_trunc('day', ts) + to_milliseconds(250 * (event_id % 8)) AS ts FROM events),
  moments AS (SELECT caller, ts, count(*) AS n FROM crowded GROUP BY 1, 2),
  within AS (SELECT *, (SELECT CAST(sum(n) AS BIGINT) FROM moments b WHERE b.caller = a.caller AND b.ts <= a.ts
    AND b.ts > a.ts - INTERVAL 1 SECOND) AS held FROM moments a)"""


@register("sliding_bursts", f"""WITH {_CROWDED}
  SELECT caller, strftime(ts, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS calls, max(held) AS peak,
    CAST(sum(greatest(0, least(n, held - 20))) AS BIGINT) AS over_burst, min(ts) FILTER (held > 20) AS first_over_at
  FROM within GROUP BY 1, 2""")
def sliding_bursts(spark, sf_dir):
    """Three callers whose calls of a day all come within two seconds after midnight, against the production limit."""
    moment = F.date_trunc("day", "ts") + F.make_dt_interval(secs=F.lit(0.25) * (F.col("event_id") % 8))
    crowded = adapters.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("string").alias("caller"), moment.cast("timestamp_ntz").alias("ts")
    )
    return operations.sliding_bursts(crowded)


@register("latency_sketches", """
  SELECT date_trunc('day', ts) AS period, count(*) AS calls, true AS near, true AS small FROM events GROUP BY 1""")
def latency_sketches(spark, sf_dir):
    """Sketches per minute, merged to five minutes and then to days: whether the day's percentile is as near as the
    sketch promises (twice its error), and no larger for a day than a sketch may be."""
    log = adapters.access_log(spark, sf_dir).select("ts", "latency_ms")
    minutes = materialize(operations.latency_sketches(log), "latency-sketches")
    days = operations.merge_sketches(operations.merge_sketches(minutes, "5 minutes"), "1 day")
    size = days.select("period", (F.octet_length("sketch") <= 16_384).alias("small"))
    value = operations.sketch_percentile(days).join(size, "period")
    ranked = log.join(value, F.date_trunc("day", "ts").cast("timestamp_ntz") == value["period"].cast("timestamp_ntz")).groupBy(
        "period", "calls", "small"
    ).agg(
        (F.count_if(F.col("latency_ms") < F.col("value")) / F.count("*")).alias("below"),
        (F.count_if(F.col("latency_ms") <= F.col("value")) / F.count("*")).alias("upto"),
    )
    off = 2 * operations.rank_error(200)
    return ranked.select(
        F.col("period").cast("timestamp_ntz").alias("period"), "calls",
        ((F.col("below") - off <= 0.99) & (F.col("upto") + off >= 0.99)).alias("near"), "small",
    )
