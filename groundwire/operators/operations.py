"""Operations data: metrics, dashboards, costs, budgets, alarms, quotas and retention."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwire.config import FAST, REASONING
from groundwire.plans.skew import salted_join
from groundwire.plans.workspace import materialize

# Metric names and units.
COUNT = "Count"
MILLISECONDS = "Milliseconds"
RUN_METRICS = (
    "AgentInvocations", "ModelTierFast", "ModelTierReasoning", "RouterEscalations",
    "GuardrailInterventions", "AgentMaxIterations", "AgentLatencyMs", "InputTokens", "OutputTokens",
)
TOOL_METRICS = ("ToolSuccess", "ToolErrors")
SERVICE_METRICS = ("Queries", "PresignedUploads", "UnhandledErrors")
INGEST_METRICS = ("DocumentsUploaded", "IngestionJobsStarted")
#: Numbers of periods a task looks at together when it finds runs of breaches.
RUN_BLOCK = 10_000
# Alarm thresholds, budget limits, quotas and retention days.
ERROR_THRESHOLD, ERROR_PERIODS = 1, 1
LATENCY_THRESHOLD_MS, LATENCY_PERIODS = 50_000, 2
BUDGET_USD, ACTUAL_SHARE, FORECAST_SHARE = 150.0, 0.80, 1.00
MONTHLY_QUOTA, BURST_LIMIT, RATE_LIMIT = 5000, 20, 10
UPLOAD_DAYS, LOG_DAYS, NONCURRENT_DAYS, INCOMPLETE_DAYS, LOG_GROUP_DAYS = 14, 90, 30, 7, 30


def _long(df: DataFrame, ts: str, metrics: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per metric whose value is not null; the wide row is read once."""
    items = [
        F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), v.cast("bigint").alias("value"))
        for n, u, v in metrics
    ]
    return df.select(
        F.col(ts).alias("ts"), F.inline(F.filter(F.array(*items), lambda m: m["value"].isNotNull()))
    )


def run_metrics(runs: DataFrame, ts: str = "requested_at") -> DataFrame:
    """Metrics of finished runs: (ts, tier, escalated, stop_cause, latency_ms, input/output tokens).

    An escalated run counts for both tiers; token counters appear only when they are not zero.
    """
    one = F.lit(1)
    escalated = F.col("escalated")
    return _long(runs, ts, [
        ("AgentInvocations", COUNT, one),
        ("ModelTierFast", COUNT, F.when(F.col("tier") == FAST, 1)),
        ("ModelTierReasoning", COUNT, F.when((F.col("tier") == REASONING) | escalated, 1)),
        ("RouterEscalations", COUNT, F.when(escalated, 1)),
        ("GuardrailInterventions", COUNT, F.when(F.col("stop_cause") == "guardrail", 1)),
        ("AgentMaxIterations", COUNT, F.when(F.col("stop_cause") == "max iterations", 1)),
        ("AgentLatencyMs", MILLISECONDS, F.col("latency_ms")),
        ("InputTokens", COUNT, F.when(F.col("input_tokens") != 0, F.col("input_tokens"))),
        ("OutputTokens", COUNT, F.when(F.col("output_tokens") != 0, F.col("output_tokens"))),
    ])


def tool_metrics(paired: DataFrame, ts: str = "requested_at") -> DataFrame:
    return _long(paired, ts, [
        ("ToolSuccess", COUNT, F.when(F.col("status") == "success", 1)),
        ("ToolErrors", COUNT, F.when(F.col("status") == "error", 1)),
    ])


def service_metrics(routed_log: DataFrame, ts: str = "ts") -> DataFrame:
    ok = F.col("outcome") == 200
    route = F.col("route")
    return _long(routed_log, ts, [
        ("Queries", COUNT, F.when(ok & route.isin("POST /v1/query", "POST /query"), 1)),
        ("PresignedUploads", COUNT,
         F.when(ok & route.isin("POST /v1/uploads/presign", "POST /uploads/presign"), 1)),
        ("UnhandledErrors", COUNT, F.when(F.col("outcome") == 500, 1)),
    ])


def ingest_metrics(jobs: DataFrame, ts: str = "period") -> DataFrame:
    return _long(jobs, ts, [
        ("DocumentsUploaded", COUNT, F.col("uploaded")),
        ("IngestionJobsStarted", COUNT, F.when(F.col("started") > 0, F.col("started"))),
    ])


def metric_rollup(metrics: DataFrame, grain: str = "1 hour") -> DataFrame:
    """Metrics per time grain. Few keys, so the map-side partial sums do nearly all the work."""
    return metrics.groupBy(F.window("ts", grain).alias("_w"), "name", "unit").agg(
        F.count("*").alias("samples"), F.sum("value").alias("total"), F.max("value").alias("maximum")
    ).select(F.col("_w.start").alias("period"), "name", "unit", "samples", "total", "maximum")


def dashboard_rollup(routed_log: DataFrame, period: str = "1 minute") -> DataFrame:
    """Errors, 5xx, invocations, throttles and mean duration per period."""
    is_query, is_ingest = F.col("service") == "query", F.col("service") == "ingest"
    failed = F.col("outcome") >= 500
    return routed_log.groupBy(F.window("ts", period).alias("_w")).agg(
        F.count_if(is_query & failed).alias("query_errors"),
        F.count_if(is_ingest & failed).alias("ingest_errors"),
        F.count_if(failed).alias("api_5xx"),
        F.round(F.avg(F.when(is_query, F.col("latency_ms"))), 4).alias("query_duration_ms"),
        F.count_if(is_query).alias("query_invocations"),
        F.count_if(is_ingest).alias("ingest_invocations"),
        F.count_if(is_query & (F.col("outcome") == 429)).alias("query_throttles"),
    ).select(F.col("_w.start").alias("period"), "*").drop("_w")


def latency_percentile(log: DataFrame, period: str = "5 minutes", share: float = 0.99) -> DataFrame:
    """Exact interpolated percentile per period.

    Calls are counted per distinct millisecond value first, so a busy period is spread over tasks
    and the percentile reads at most one entry per value.
    """
    counted = log.groupBy(F.window("ts", period).alias("_w"), "latency_ms").agg(F.count("*").alias("_n"))
    return counted.groupBy("_w").agg(
        F.round(F.percentile("latency_ms", share, F.col("_n")), 4).alias("value"),
        F.sum("_n").alias("calls"),
    ).select(F.col("_w.start").alias("period"), "value", "calls")


def period_index(period: Column, seconds: int) -> Column:
    """Number of a period since 1970 by wall-clock time, so it does not depend on the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, period.cast("timestamp_ntz")) / seconds)


def breach_runs(series: DataFrame, period_seconds: int, threshold: float) -> DataFrame:
    """Runs of consecutive breaching periods: (alarm, first, last, from, to, breaching), first and last as numbers
    of periods since the epoch.

    Runs are found within blocks of RUN_BLOCK consecutive numbers, and what touches across blocks is joined
    afterwards, so a task sees one block of an alarm, and then one row per run and block.
    """
    numbered = series.filter(F.col("value") >= threshold).select(
        "alarm", "period", period_index(F.col("period"), period_seconds).alias("n")
    )
    place = Window.partitionBy("alarm", "_block").orderBy("n")
    within = numbered.withColumn("_block", F.floor(F.col("n") / RUN_BLOCK)).withColumn("_run", F.col("n") - F.row_number().over(place))
    pieces = within.groupBy("alarm", "_block", "_run").agg(
        F.min("n").alias("first"), F.max("n").alias("last"), F.min("period").alias("from"), F.max("period").alias("to")
    )
    chain = Window.partitionBy("alarm").orderBy("first")
    opens = F.coalesce(F.col("first") != F.lag("last").over(chain) + 1, F.lit(True))
    return pieces.withColumn("_no", F.sum(opens.cast("int")).over(chain)).groupBy("alarm", "_no").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("from").alias("from"), F.max("to").alias("to")
    ).withColumn("breaching", F.col("last") - F.col("first") + 1).drop("_no")


def alarm_periods(
    metrics: DataFrame, period_seconds: int, threshold: float, periods: int
) -> DataFrame:
    """Spans in ALARM: (alarm, alarm_from, alarm_to, breaching).

    ``metrics``: (alarm, period, value), one row per alarm and period. The state is ALARM from the
    ``periods``-th consecutive breach on; a missing period counts as fine.
    """
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(period_seconds * (periods - 1))))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(period_seconds)))
    return breach_runs(metrics, period_seconds, threshold).filter(F.col("breaching") >= periods).select(
        "alarm", (F.col("from") + shift).alias("alarm_from"), (F.col("to") + step).alias("alarm_to"), "breaching",
    )


def alarm_edges(series: DataFrame, period_seconds: int, threshold: float, periods: int) -> DataFrame:
    """State changes (alarm, period_index, state, run) of closed windows (alarm, period, value): ALARM when a run
    of breaches reaches ``periods``, OK right after its last one, once a later window has closed.

    Reads the table of closed windows, so the order in which a stream wrote them does not matter.
    """
    runs = breach_runs(series, period_seconds, threshold).filter(F.col("breaching") >= periods)
    newest = series.groupBy("alarm").agg(F.max(period_index(F.col("period"), period_seconds)).alias("newest"))
    on = runs.select(
        "alarm", (F.col("first") + periods - 1).alias("period_index"), F.lit("ALARM").alias("state"),
        F.lit(periods).cast("long").alias("run"),
    )
    off = runs.join(newest, "alarm").filter(F.col("newest") > F.col("last")).select(
        "alarm", (F.col("last") + 1).alias("period_index"), F.lit("OK").alias("state"), F.col("breaching").alias("run")
    )
    return on.unionByName(off)


def error_series(dashboard: DataFrame) -> DataFrame:
    """The three error alarms' series out of the minute rollup."""
    items = F.array(*[
        F.struct(F.lit(name).alias("alarm"), F.col(column).alias("value"))
        for name, column in (
            ("QueryErrors", "query_errors"), ("IngestErrors", "ingest_errors"), ("Api5xx", "api_5xx"),
        )
    ])
    return dashboard.select("period", F.inline(items))


def cost_attribution(
    usage: DataFrame, prices: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Cost per project, tier and model with subtotals (null = all).

    ``usage``: (project, tier, model_id, input_tokens, output_tokens). ``prices``: tier to USD per 1000 input
    and output tokens. Tokens are summed as integers and priced afterwards.
    """
    tokens = usage.rollup("project", "tier", "model_id").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        *[
            F.sum(F.when(F.col("tier") == tier, F.col(kind))).alias(f"_{tier}_{kind}")
            for tier in prices for kind in ("input_tokens", "output_tokens")
        ],
    )
    cost = F.lit(0.0)
    for tier, (per_input, per_output) in prices.items():
        cost = (
            cost + F.coalesce(f"_{tier}_input_tokens", F.lit(0)) * (per_input / 1000)
            + F.coalesce(f"_{tier}_output_tokens", F.lit(0)) * (per_output / 1000)
        )
    return tokens.select(
        "project", "tier", "model_id", "requests", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd")
    )


def budget_status(costs: DataFrame, limit: float = BUDGET_USD) -> DataFrame:
    """Month-to-date spend per day, forecast and alerts; costs are summed per day before the window.

    Money is summed as decimals, so the result does not depend on the order of the rows.
    """
    day = F.to_date("ts")
    daily = costs.groupBy(day.alias("day")).agg(F.sum(F.col("cost").cast("decimal(18,6)")).alias("_spend"))
    month = Window.partitionBy(F.trunc("day", "month")).orderBy("day")
    to_date = F.sum("_spend").over(month.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    forecast = F.col("month_to_date") / F.dayofmonth("day") * F.dayofmonth(F.last_day("day"))
    return daily.withColumn("month_to_date", to_date).select(
        "day", F.col("_spend").cast("double").alias("spend"), "month_to_date", forecast.alias("forecast"),
        (F.col("month_to_date") > limit * ACTUAL_SHARE).alias("actual_alert"),
        (forecast > limit * FORECAST_SHARE).alias("forecast_alert"),
    )


def quota_usage(
    log: DataFrame, monthly: int = MONTHLY_QUOTA, burst: int = BURST_LIMIT, rate: int = RATE_LIMIT
) -> DataFrame:
    """Per caller and month: calls, the first call over the quota, and busy seconds.

    One caller may make most of the calls, so nothing ranks a caller's raw calls. Calls are counted
    per second and minute; the minute in which the quota runs out is found on the counts and written, one
    row per caller and month at most, so Spark knows its size and need not shuffle the log to meet it.
    Only calls inside that minute are ranked, at most ``monthly + 1`` of them per task. Calls without a
    caller belong to no quota.
    """
    # Both uses of the counts carry the same filter, so Spark computes their shuffle once. Truncated
    # times are plain numbers; formatting a text per call would cost more than counting it.
    calls = log.filter(F.col("caller").isNotNull() & F.col("ts").isNotNull()).select(
        "caller", "ts", "event_id", F.trunc("ts", "month").alias("month"),
        F.date_trunc("minute", "ts").alias("minute"),
    )
    seconds = calls.groupBy("caller", "month", "minute", F.date_trunc("second", "ts").alias("second")).agg(
        F.count("*").alias("n")
    )
    minutes = seconds.groupBy("caller", "month", "minute").agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > burst).alias("over_burst"),
        F.count_if(F.col("n") > rate).alias("over_rate"), F.max("n").alias("peak"),
    )
    so_far = Window.partitionBy("caller", "month").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    counted = minutes.withColumn("_total", F.sum("n").over(so_far))
    crossing = counted.filter(
        (F.col("_total") > monthly) & (F.col("_total") - F.col("n") <= monthly)
    ).select("caller", "minute", (F.col("_total") - F.col("n")).alias("_before"))
    crossing = materialize(crossing, "quota-minutes")
    rank = Window.partitionBy("caller", "minute").orderBy("ts", "event_id")
    # The first of these filters is a constant bound, which Spark applies before the shuffle.
    first_over = (
        calls.join(crossing, ["caller", "minute"])
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= monthly + 1)
        .filter(F.col("_rank") == F.lit(monthly + 1) - F.col("_before"))
        .select("caller", "month", F.col("ts").alias("first_over_at"), F.col("event_id").alias("first_over_event"))
    )
    summary = minutes.groupBy("caller", "month").agg(
        F.sum("n").alias("calls"), F.sum("over_burst").alias("burst_seconds"),
        F.sum("over_rate").alias("rate_seconds"), F.max("peak").alias("peak_per_second"),
    )
    return summary.join(first_over, ["caller", "month"], "left").withColumns({
        "month": F.date_format("month", "yyyy-MM"), "over_quota": F.col("calls") > monthly,
    })


def with_noncurrent_since(versions: DataFrame) -> DataFrame:
    """Add when a version stopped being current: the creation time of the next one of its key.

    A key may hold very many versions, so ranks run per key and hour; only the last version of an hour
    looks at the following hours, through one summary row per key and hour. Only what the report reads
    is carried.
    """
    within = Window.partitionBy("bucket", "key", "_hour").orderBy("created", "version_id")
    across = Window.partitionBy("bucket", "key").orderBy("_hour")
    dated = versions.select(
        "bucket", "key", "version_id", "created", "state", "size", F.date_trunc("hour", "created").alias("_hour")
    )
    following = dated.groupBy("bucket", "key", "_hour").agg(F.min("created").alias("_first")).withColumn(
        "_later", F.lead("_first").over(across)
    ).drop("_first")
    ranked = dated.withColumn("_next", F.lead("created").over(within))
    joined = salted_join(ranked, following, ["bucket", "key", "_hour"], [F.col("version_id")])
    return joined.withColumn("noncurrent_since", F.coalesce("_next", "_later")).drop("_hour", "_next", "_later")


def retention_report(versions: DataFrame, as_of: str) -> DataFrame:
    """Versions due for expiry by rule: (bucket, rule, versions, bytes, oldest).

    ``versions``: bucket (documents, uploads, logs or log-groups), key, version_id, created, state
    (stored or incomplete), size, and ``noncurrent_since``.
    """
    today = F.lit(as_of).cast("timestamp_ntz")

    def older(column: str, days: int) -> Column:
        return F.col(column) <= today - F.make_dt_interval(F.lit(days))

    current = F.col("noncurrent_since").isNull()
    is_data = F.col("bucket").isin("documents", "uploads")
    stored = F.col("state") != "incomplete"
    rule = (
        F.when(is_data & ~stored & older("created", INCOMPLETE_DAYS), "incomplete upload")
        .when(stored & is_data & ~current & older("noncurrent_since", NONCURRENT_DAYS), "old version")
        .when(stored & current & (F.col("bucket") == "uploads") & F.col("key").startswith("uploads/")
              & older("created", UPLOAD_DAYS), "upload age")
        .when(stored & current & (F.col("bucket") == "logs") & older("created", LOG_DAYS), "log age")
        .when(stored & current & (F.col("bucket") == "log-groups") & older("created", LOG_GROUP_DAYS),
              "log group age")
    )
    return versions.withColumn("rule", rule).filter(F.col("rule").isNotNull()).groupBy("bucket", "rule").agg(
        F.count("*").alias("versions"), F.sum("size").alias("bytes"), F.min("created").alias("oldest")
    )


def ingestion_jobs(notifications: DataFrame, interval: str = "5 minutes", configured: bool = True) -> DataFrame:
    """Uploads and job outcome per trigger interval.

    The first notification of an interval starts the job; the others meet a running job and are
    skipped as conflicts. Without a configured knowledge base every trigger is skipped.
    """
    jobs = notifications.groupBy(F.window("ts", interval).alias("_w")).agg(F.count("*").alias("uploaded"))
    started = F.lit(1 if configured else 0).cast("bigint")
    return jobs.select(
        F.col("_w.start").alias("period"), "uploaded", started.alias("started"),
        (F.col("uploaded") - started if configured else F.lit(0).cast("bigint")).alias("conflicts"),
        (F.lit(0).cast("bigint") if configured else F.col("uploaded")).alias("not_configured"),
    )


def ingestion_stats(jobs: DataFrame) -> DataFrame:
    """Long form: (status, reason, n) over all intervals."""
    totals = jobs.agg(*[F.sum(c).alias(c) for c in ("uploaded", "started", "conflicts", "not_configured")])
    rows = F.array(*[
        F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.col(c).alias("n"))
        for s, r, c in (
            ("uploaded", "-", "uploaded"), ("started", "-", "started"),
            ("skipped", "ConflictException", "conflicts"), ("skipped", "ids not set", "not_configured"),
        )
    ])
    return totals.select(F.inline(rows)).filter(F.col("n") > 0)


def busy_jobs(triggers: DataFrame, seconds: float) -> DataFrame:
    """Ingestion jobs that run for ``seconds``: (started, uploaded, conflicts).

    ``triggers``: ts, and optionally valid. The first trigger starts a job, those that arrive while it runs meet a
    running job and are skipped as conflicts, the next one starts another, and so on. Triggers without a time or
    that are not valid start nothing and conflict with nothing.

    Which triggers start jobs hangs on all before them. So each range of times first says, for every moment until
    which an earlier job may keep it busy, until when it is busy itself (few rows, since chains that start apart soon
    meet); these are put together range by range, and each range then knows its jobs. Times are counted before
    they are dealt, so no moment is hot, and nothing is gathered but those few rows.
    """
    spark = triggers.sparkSession
    kind = triggers.schema["ts"].dataType.simpleString()
    lasts = int(round(seconds * 1_000_000))
    valid = F.col("ts").isNotNull() & (F.col("valid") if "valid" in triggers.columns else F.lit(True))
    times = triggers.filter(valid).groupBy(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = times.repartitionByRange(ranges, "t").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "trigger-times")

    def ways_through(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        following = np.searchsorted(t, t + lasts)
        out = t + lasts
        for i in range(len(t) - 1, -1, -1):
            if following[i] < len(t):
                out[i] = out[following[i]]
        # an earlier job started before t[0], so it is over by t[0] + lasts
        entries = min(len(t), int(np.searchsorted(t, t[0] + lasts)) + 1)
        ends = np.flatnonzero(np.append(out[1:entries] != out[: entries - 1], True))
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "until": t[ends], "busy": out[ends]})

    ways = dealt.groupBy("part").applyInPandas(ways_through, "part int, until long, busy long")
    entry, busy, done = {}, None, None
    for row in ways.orderBy("part", "until").toLocalIterator():
        if row.part not in entry:
            entry[row.part], done = busy, False
        if not done and (entry[row.part] is None or row.until >= entry[row.part]):
            busy, done = row.busy, True
    entries = spark.sparkContext.broadcast(entry)

    def jobs_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, n = pdf["t"].to_numpy(), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        until = entries.value[int(pdf["part"].iloc[0])]
        found, at = [], 0
        if until is not None:
            at = int(np.searchsorted(t, until))
            if at:
                found.append((until - lasts, n[at]))
        while at < len(t):
            end = int(np.searchsorted(t, t[at] + lasts))
            found.append((t[at], n[end] - n[at]))
            at = end
        return pd.DataFrame(found, columns=["started", "uploaded"]).astype("int64")

    jobs = dealt.groupBy("part").applyInPandas(jobs_of, "started long, uploaded long").groupBy("started").agg(
        F.sum("uploaded").alias("uploaded")
    )
    return jobs.select(
        F.timestamp_micros("started").cast(kind).alias("started"), "uploaded", (F.col("uploaded") - 1).alias("conflicts")
    )


def busy_job_stats(triggers: DataFrame, seconds: float) -> DataFrame:
    """Long form (status, reason, n) of triggers that met ``busy_jobs``, with the skips that the service names."""
    def told(totals: DataFrame, *rows: tuple[str, str, str]) -> DataFrame:
        named = [F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.col(c).alias("n")) for s, r, c in rows]
        return totals.select(F.inline(F.array(*named)))

    valid = F.col("valid") if "valid" in triggers.columns else F.lit(True)
    met = triggers.agg(F.count("*").alias("uploaded"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("refused"))
    jobs = busy_jobs(triggers, seconds).agg(F.count("*").alias("started"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"))
    return told(met, ("uploaded", "-", "uploaded"), ("skipped", "ValidationException", "refused")).unionByName(
        told(jobs, ("started", "-", "started"), ("skipped", "ConflictException", "conflicts"))
    ).filter(F.col("n") > 0)


def sliding_bursts(log: DataFrame, limit: int = BURST_LIMIT, seconds: float = 1.0) -> DataFrame:
    """Per caller and month: calls, the most in any span of ``seconds``, wherever it begins, how many calls came on
    top of ``limit`` in the span that ends with them, and when the first of these came.

    Calls are counted per caller and moment. A caller's moments are looked at in blocks of 64 spans, each with the
    moments of the last span before it as a halo, so a burst across a border counts and no caller is gathered. Calls
    without a caller or time belong to no quota.
    """
    kind = log.schema["ts"].dataType.simpleString()
    span = int(round(seconds * 1_000_000))
    length = 64 * span
    known = log.filter(F.col("caller").isNotNull() & F.col("ts").isNotNull())
    moments = known.groupBy("caller", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))
    inside = F.pmod(F.col("t"), F.lit(length))
    placed = moments.withColumn("_block", F.floor(F.col("t") / length))
    # one row for each block that a moment counts in: its own, and the next one's halo
    blocks = F.when(inside > length - span, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = placed.withColumn("_ahead", F.explode(blocks)).withColumn("_block", F.col("_block") + F.col("_ahead"))
    before = Window.partitionBy("caller", "_block").orderBy("t").rangeBetween(1 - span, 0)
    counted = dealt.withColumn("_within", F.sum("n").over(before)).filter("_ahead = 0")
    over = F.greatest(F.lit(0), F.least(F.col("n"), F.col("_within") - limit))
    when = F.timestamp_micros("t").cast(kind)
    return counted.groupBy("caller", F.date_format(when, "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("calls"), F.max("_within").alias("peak"), F.sum(over).alias("over_burst"),
        F.min(F.when(F.col("_within") > limit, when)).alias("first_over_at"),
    )


def rank_error(k: int) -> float:
    """How far the rank of a sketch's percentile may be off, with a chance of 1 % to be further: of a KLL sketch."""
    return 2.296 / k**0.9723


def latency_sketches(log: DataFrame, period: str = "1 minute", k: int = 200) -> DataFrame:
    """Per period the number of calls and a sketch of their latencies, whose size does not grow with the calls. Calls
    without a time or latency are left out."""
    timed = log.filter(F.col("ts").isNotNull() & F.col("latency_ms").isNotNull())
    return timed.groupBy(F.window("ts", period).alias("_w")).agg(
        F.count("*").alias("calls"), F.kll_sketch_agg_bigint("latency_ms", k).alias("sketch")
    ).select(F.col("_w.start").alias("period"), "calls", "sketch")


def merge_sketches(sketches: DataFrame, period: str) -> DataFrame:
    """Sketches of longer periods from those of shorter ones; the calls are not read again."""
    return sketches.groupBy(F.window("period", period).alias("_w")).agg(
        F.sum("calls").alias("calls"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    ).select(F.col("_w.start").alias("period"), "calls", "sketch")


def sketch_percentile(sketches: DataFrame, share: float = 0.99) -> DataFrame:
    """(period, value, calls): a latency whose rank is ``share`` but for ``rank_error``."""
    return sketches.select(
        "period", F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share))).alias("value"), "calls"
    )
