"""Metrics, alarms, budgets, quotas, retention: edge cases on small rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from groundwire.operators import operations as ops
from groundwire.sources.objects import audit_events

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def test_alarm_needs_consecutive_breaches(spark):
    values = [("p99", 0, 60.0), ("p99", 300, 60.0), ("p99", 600, 10.0), ("p99", 900, 60.0), ("p99", 1500, 60.0),
              ("p99", 1800, 50.0), ("p99", 2100, 60.0), ("one", 0, 60.0)]
    df = ntz(spark.createDataFrame([(a, at(s), v) for a, s, v in values], "alarm string, period timestamp, value double"), "period")
    got = ops.alarm_periods(df, 300, 50.0, 2).orderBy("alarm_from").collect()
    assert [(r.alarm, r.alarm_from, r.alarm_to, r.breaching) for r in got] == [
        ("p99", at(300), at(600), 2), ("p99", at(1800), at(2400), 3)]
    single = ops.alarm_periods(df, 300, 50.0, 1).filter("alarm = 'p99'").orderBy("alarm_from").collect()
    assert [(r.alarm_from, r.alarm_to) for r in single] == [(at(0), at(600)), (at(900), at(1200)), (at(1500), at(2400))]


def test_budget_alerts_are_strict(spark):
    days = [(dt.datetime(2024, 2, 1, 5), 100.0), (dt.datetime(2024, 2, 1, 6), 20.0), (dt.datetime(2024, 2, 29), 0.5), (dt.datetime(2024, 3, 1), 1.0)]
    df = ntz(spark.createDataFrame(days, "ts timestamp, cost double"), "ts")
    got = ops.budget_status(df).orderBy("day").collect()
    assert [(r.month_to_date, r.actual_alert, r.forecast_alert) for r in got] == [
        (120.0, False, True), (120.5, True, False), (1.0, False, False)]
    assert got[0].forecast == 120.0 * 29 and got[1].forecast == 120.5


@pytest.mark.parametrize("quota", [1, 7, 50, 400])
def test_quota_against_brute_force(spark, quota):
    rng = random.Random(5)
    # One caller makes most calls, many of them within one second.
    calls = [("hot" if rng.random() < 0.7 else f"c{rng.randrange(4)}", at(rng.choice([3, 3, 3, rng.randrange(40 * 86400)])), n) for n in range(600)]
    df = ntz(spark.createDataFrame(calls, "caller string, ts timestamp, event_id long"), "ts")
    got = {(r.caller, r.month): r for r in ops.quota_usage(df, quota, burst=20, rate=10).collect()}
    groups = {}
    for c, t, n in calls:
        groups.setdefault((c, t.strftime("%Y-%m")), []).append((t, n))
    assert set(got) == set(groups)
    for key, mine in groups.items():
        mine.sort()
        seconds = {}
        for t, _ in mine:
            seconds[t] = seconds.get(t, 0) + 1
        row = got[key]
        first = mine[quota] if len(mine) > quota else (None, None)
        assert (row.calls, row.first_over_at, row.first_over_event, row.over_quota) == (len(mine), *first, len(mine) > quota)
        assert row.burst_seconds == sum(v > 20 for v in seconds.values())
        assert (row.rate_seconds, row.peak_per_second) == (sum(v > 10 for v in seconds.values()), max(seconds.values()))


def test_retention_rules_at_the_limit(spark):
    day = lambda n: dt.datetime(2024, 6, 30) - dt.timedelta(days=n)
    rows = [
        ("uploads", "uploads/a", 1, day(14), "stored", 1), ("uploads", "uploads/b", 2, day(13), "stored", 1),
        ("uploads", "other/c", 3, day(99), "stored", 1), ("logs", "x", 4, day(90), "stored", 1), ("logs", "y", 5, day(89), "stored", 1),
        ("documents", "knowledge/k", 6, day(80), "stored", 5), ("documents", "knowledge/k", 7, day(30), "stored", 6),
        ("documents", "knowledge/k", 8, day(29), "stored", 7), ("documents", "p", 9, day(7), "incomplete", 2), ("documents", "q", 10, day(6), "incomplete", 2),
    ]
    df = ntz(spark.createDataFrame(rows, "bucket string, key string, version_id long, created timestamp, state string, size long"), "created")
    versions = ops.with_noncurrent_since(df)
    since = {r.version_id: r.noncurrent_since for r in versions.collect()}
    assert (since[6], since[7], since[8]) == (day(30), day(29), None)
    got = {(r.bucket, r.rule): (r.versions, r.bytes) for r in ops.retention_report(versions, "2024-06-30").collect()}
    assert got == {("uploads", "upload age"): (1, 1), ("logs", "log age"): (1, 1), ("documents", "old version"): (1, 5),
                   ("documents", "incomplete upload"): (1, 2)}


def test_run_metrics_skip_zero_counters(spark):
    rows = [(T0, "fast", True, "answered", 12, 0, 7), (T0, "reasoning", False, "guardrail", 5, 3, 0), (T0, "fast", False, "max iterations", 1, 1, 1)]
    df = ntz(spark.createDataFrame(rows, "requested_at timestamp, tier string, escalated boolean, stop_cause string, latency_ms long, input_tokens long, output_tokens long"), "requested_at")
    got = {r.name: (r.samples, r.total) for r in ops.metric_rollup(ops.run_metrics(df)).collect()}
    assert got == {"AgentInvocations": (3, 3), "ModelTierFast": (2, 2), "ModelTierReasoning": (2, 2), "RouterEscalations": (1, 1),
                   "GuardrailInterventions": (1, 1), "AgentMaxIterations": (1, 1), "AgentLatencyMs": (3, 18), "InputTokens": (2, 4), "OutputTokens": (2, 8)}
    assert set(got) == set(ops.RUN_METRICS)


def test_costs_and_jobs(spark):
    usage = spark.createDataFrame([("p", "fast", 1000, 2000), ("p", "reasoning", 1000, 0), ("q", "fast", 500, 0)], "project string, tier string, input_tokens long, output_tokens long")
    usage = usage.withColumn("model_id", F.concat(F.lit("model-"), "tier"))
    costs = ops.cost_attribution(usage, {"fast": (1.0, 2.0), "reasoning": (10.0, 20.0)}).collect()
    assert {(r.project, r.model_id): r.cost_usd for r in costs if r.model_id} == {
        ("p", "model-fast"): 5.0, ("p", "model-reasoning"): 10.0, ("q", "model-fast"): 0.5}
    got = {(r.project, r.tier): r.cost_usd for r in costs if not r.model_id}
    assert got == {("p", "fast"): 5.0, ("p", "reasoning"): 10.0, ("p", None): 15.0, ("q", "fast"): 0.5, ("q", None): 0.5, (None, None): 15.5}
    notices = ntz(spark.createDataFrame([(at(0),), (at(10),), (at(400),)], "ts timestamp"), "ts")
    stats = {(r.status, r.reason): r.n for r in ops.ingestion_stats(ops.ingestion_jobs(notices)).collect()}
    assert stats == {("uploaded", "-"): 3, ("started", "-"): 2, ("skipped", "ConflictException"): 1}
    off = {(r.status, r.reason): r.n for r in ops.ingestion_stats(ops.ingestion_jobs(notices, configured=False)).collect()}
    assert off == {("uploaded", "-"): 3, ("skipped", "ids not set"): 3}


def test_audit_keeps_management_and_data_buckets(spark):
    rows = [(None, "signup"), ("documents", "get"), ("documents", "put"), ("other", "get")]
    got = {(r.event_class, r.bucket, r.verb, r.access) for r in audit_events(spark.createDataFrame(rows, "bucket string, verb string"), ["documents"]).collect()}
    assert got == {("management", "-", "signup", "write"), ("data", "documents", "get", "read"), ("data", "documents", "put", "write")}


def test_jobs_follow_one_another(spark):
    """Against a plain loop, in one range of times and in many, with gaps, ties, chains without a gap and nulls."""

    draw = random.Random(8)
    dense = sorted(draw.randrange(20_000) for _ in range(900))
    sparse = sorted(draw.randrange(10**6) for _ in range(300))
    zero = dt.datetime(2024, 1, 1)
    for times, lasts in ((dense, 61), (dense, 3000), (sparse, 2000), (dense + [30_000 + 60 * n for n in range(400)], 60), ([5, 5, 5], 10), ([], 10)):
        want, until = {}, None
        for t in sorted(times):
            if until is None or t >= until:
                start, until = t, t + lasts
                want[start] = 0
            want[start] += 1
        rows = [(zero + dt.timedelta(seconds=t), True) for t in times] + [(None, True), (zero + dt.timedelta(seconds=3), False), (zero, None)]
        df = spark.createDataFrame(rows, "ts timestamp_ntz, valid boolean").repartition(3)
        got = {(r.started - zero).total_seconds(): (r.uploaded, r.conflicts) for r in ops.busy_jobs(df, lasts).collect()}
        assert got == {float(t): (n, n - 1) for t, n in want.items()}
        stats = {(r.status, r.reason): r.n for r in ops.busy_job_stats(df, lasts).collect()}
        assert stats[("uploaded", "-")] == len(rows) and stats[("skipped", "ValidationException")] == 2
        assert stats.get(("started", "-"), 0) == len(want)


def test_bursts_slide_over_borders(spark):
    """Against counting around every call, with bursts across seconds, blocks of spans and months, ties and nulls."""
    draw = random.Random(9)
    zero = dt.datetime(2024, 1, 31, 23, 59, 0)
    moments = [draw.choice([59.2, 60.1, 0.0, 63.9, 64.0, 127.9, 128.3]) + draw.random() * draw.choice([0.1, 1, 5]) for _ in range(400)]
    calls = [(draw.choice("ab"), zero + dt.timedelta(microseconds=int(m * 1e6))) for m in moments]
    calls += calls[:30] + [("c", zero)]
    df = spark.createDataFrame([*calls, (None, zero), ("a", None)], "caller string, ts timestamp_ntz").repartition(4)
    for limit, seconds in ((20, 1.0), (5, 0.25), (0, 1.0)):
        want = {}
        span = dt.timedelta(seconds=seconds)
        for caller, t in set(calls):
            n = calls.count((caller, t))
            held = sum(c == caller and t - span < u <= t for c, u in calls)
            row = want.setdefault((caller, t.strftime("%Y-%m")), [0, 0, 0, None])
            row[0] += n
            row[1] = max(row[1], held)
            row[2] += max(0, min(n, held - limit))
            if held > limit:
                row[3] = min(row[3] or t, t)
        got = {(r.caller, r.month): [r.calls, r.peak, r.over_burst, r.first_over_at] for r in ops.sliding_bursts(df, limit, seconds).collect()}
        assert got == want


def test_merged_sketches_stay_near(spark):
    """Merged in two ways, of few and of many calls: the rank is right but for the stated error, the size is bounded."""
    draw = random.Random(10)
    zero = dt.datetime(2024, 1, 2)  # two-day windows count from 1970
    values = [int(draw.lognormvariate(6, 1)) for _ in range(30_000)]
    rows = [(zero + dt.timedelta(seconds=3 * n), v) for n, v in enumerate(values)] + [(zero + dt.timedelta(days=3), 7), (None, 1), (zero, None)]
    log = spark.createDataFrame(rows, "ts timestamp, latency_ms long").repartition(6)
    minutes = ops.latency_sketches(log)
    for days in (ops.merge_sketches(minutes, "2 days"), ops.merge_sketches(ops.merge_sketches(minutes, "1 hour"), "2 days")):
        for share in (0.5, 0.99):
            first, last = ops.sketch_percentile(days, share).orderBy("period").collect()
            assert (first.calls, last.calls, last.value) == (30_000, 1, 7)
            off = 2 * ops.rank_error(200)
            assert sum(v < first.value for v in values) / 30_000 - off <= share <= sum(v <= first.value for v in values) / 30_000 + off
        assert max(len(r.sketch) for r in days.collect()) < 16_384
