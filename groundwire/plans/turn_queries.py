"""Turns, tool calls, agent runs and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.config import EngineConfig
from groundwire.operators import operations, tool_loop as loops, turns
from groundwire.plans import oracle_views as v
from groundwire.plans.registry import register
from groundwire.plans.workspace import materialize
from groundwire.sources import adapters
from groundwire.sources.access_log import with_routes

CONFIG = EngineConfig()


def sessions(spark, sf_dir):
    return adapters.table(spark, sf_dir, "conversations").withColumn(
        "session_id", F.col("conv_id").cast("string")
    )


@register("pair_turns", """
  SELECT CAST(u.conv_id AS VARCHAR) AS session_id, u.turn, u.text AS question, a.text AS answer,
    a.turn IS NOT NULL AS answered
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant'
    AND a.turn = (SELECT min(n.turn) FROM conversations n WHERE n.conv_id = u.conv_id AND n.turn > u.turn AND n.role = 'assistant')
  WHERE u.role = 'user'""")
def pair_turns(spark, sf_dir):
    return turns.pair_turns(sessions(spark, sf_dir))


@register("pair_turns_shared", """
  WITH odd AS (SELECT CASE WHEN conv_id % 7 > 0 THEN CAST(conv_id AS VARCHAR) END AS session_id,
    CASE WHEN turn <> 5 THEN turn // 2 END AS turn, role, text FROM conversations)
  SELECT u.session_id, u.turn, u.text AS question,
    (SELECT min(a.text) FROM odd a WHERE a.session_id = u.session_id AND a.role = 'assistant' AND a.turn =
      (SELECT min(n.turn) FROM odd n WHERE n.session_id = u.session_id AND n.role = 'assistant' AND n.turn > u.turn)) AS answer,
    EXISTS (SELECT 1 FROM odd n WHERE n.session_id = u.session_id AND n.role = 'assistant' AND n.turn > u.turn) AS answered
  FROM odd u WHERE u.role = 'user'""")
def pair_turns_shared(spark, sf_dir):
    """Turns that share numbers, and turns and sessions without one: every question stays, once."""
    stored = adapters.table(spark, sf_dir, "conversations")
    return turns.pair_turns(stored.select(
        F.when(F.col("conv_id") % 7 > 0, F.col("conv_id").cast("string")).alias("session_id"),
        F.when(F.col("turn") != 5, F.floor(F.col("turn") / 2)).alias("turn"), "role", "text",
    ))


@register("assemble_messages", """
  SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_messages,
    string_agg(turn || ':' || role || ':' || text, chr(30) ORDER BY turn) AS transcript
  FROM conversations GROUP BY 1""")
def assemble_messages(spark, sf_dir):
    runs = turns.assemble_messages(sessions(spark, sf_dir))
    line = lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"])
    return runs.select(
        "session_id", "n_messages",
        F.array_join(F.transform("messages", line), "\x1e").alias("transcript"),
    )


@register("low_confidence_answers", f"""WITH {v.ANSWERS}
  SELECT answer_id, session_id, answer, {v.LOW_CONFIDENCE} AS low_confidence FROM answers""")
def low_confidence_answers(spark, sf_dir):
    return turns.low_confidence_answers(adapters.answers(spark, sf_dir))


def paired_of(calls, spark, sf_dir):
    asked = adapters.tool_calls_of(calls)
    results = adapters.tool_results_of(asked, adapters.table(spark, sf_dir, "conversations"))
    return turns.pair_tool_results(asked, results)


def paired(spark, sf_dir):
    return paired_of(adapters.model_calls(spark, sf_dir), spark, sf_dir)


@register("pair_tool_results", f"""WITH {v.TOOL_RESULTS}
  SELECT request_id, i, position, input, tool_use_id, tool, status, output_preview FROM paired""")
def pair_tool_results(spark, sf_dir):
    return paired(spark, sf_dir)


@register("tool_stats", f"""WITH {v.TOOL_RESULTS}
  SELECT tool, count(*) AS calls, count(*) FILTER (status = 'error') AS errors,
    count(*) FILTER (status = 'error') / count(*) AS error_rate FROM paired GROUP BY 1""")
def tool_stats(spark, sf_dir):
    return turns.tool_stats(paired(spark, sf_dir))


@register("citation_grounding", f"""WITH {v.ANSWERS},
  mentions AS (SELECT DISTINCT answer_id, session_id,
    unnest(regexp_extract_all(answer, {v.lit(turns.URI_PATTERN)})) AS uri FROM answers),
  checked AS (SELECT answer_id, count(*) AS cited,
    count(*) FILTER (uri <> 's3://docs/' || session_id) AS ungrounded FROM mentions GROUP BY 1)
  SELECT a.answer_id, session_id, coalesce(cited, 0) AS cited, coalesce(ungrounded, 0) AS ungrounded,
    CASE WHEN cited IS NULL THEN 'no citation' WHEN ungrounded > 0 THEN 'ungrounded' ELSE 'grounded' END AS verdict
  FROM answers a LEFT JOIN checked USING (answer_id)""")
def citation_grounding(spark, sf_dir):
    return turns.citation_grounding(adapters.answers(spark, sf_dir), adapters.citations(spark, sf_dir))


def looped(spark, sf_dir):
    return loops.tool_loop(adapters.model_calls(spark, sf_dir), CONFIG)


@register("tool_loop", f"""WITH {v.LOOPED}
  SELECT request_id, i, stop_reason, effective_tier, escalation, discarded, stop_cause FROM looped""")
def tool_loop(spark, sf_dir):
    return looped(spark, sf_dir).select(
        "request_id", "i", "stop_reason", "effective_tier", "escalation", "discarded", "stop_cause"
    )


@register("escalation_report", f"""WITH {v.LOOPED},
  starts AS (SELECT reason, count(*) AS fast_starts FROM looped WHERE i = 0 AND tier = 'fast' GROUP BY 1)
  SELECT reason, escalation AS cause, count(*) AS escalations, any_value(fast_starts) AS fast_starts,
    count(*) / any_value(fast_starts) AS rate
  FROM looped JOIN starts USING (reason) WHERE escalation IS NOT NULL GROUP BY 1, 2""")
def escalation_report(spark, sf_dir):
    return loops.escalation_report(looped(spark, sf_dir))


def usage_of(calls):
    members = F.to_json(F.struct(
        F.col("input_tokens").alias("inputTokens"), (F.col("output_tokens") + 0.75).alias("outputTokens"),
        F.lit("standard").alias("service"), F.col("input_tokens").cast("string").alias("billed"),
    ))
    return calls.select("request_id", F.from_json(members, "map<string,variant>").alias("usage"))


@register("accumulate_usage", f"""WITH {v.CALLS}
  SELECT request_id, 'inputTokens' AS key, CAST(sum(input_tokens) AS BIGINT) AS value FROM calls GROUP BY 1
  UNION ALL SELECT request_id, 'outputTokens', CAST(sum(output_tokens) AS BIGINT) FROM calls GROUP BY 1""")
def accumulate_usage(spark, sf_dir):
    """Output counters carry a fraction, which is cut; entries that are text, numeric or not, are ignored."""
    return loops.accumulate_usage(usage_of(adapters.model_calls(spark, sf_dir)))


def final_runs(run):
    """Final responses with the run's token counts and start time as plain columns."""
    return loops.finalize_responses(run, config=CONFIG, totals={
        "requested_at": F.min("requested_at"), "tier": F.first("tier"),
        "input_tokens": F.sum("input_tokens"), "output_tokens": F.sum("output_tokens"),
        "escalated": F.max("escalation").isNotNull(),
    })


FINAL = v.LOOPED + f""",
last_calls AS (SELECT request_id, max(i) AS i, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  max(escalation) AS cause FROM looped GROUP BY 1),
final AS (SELECT l.request_id,
  CASE WHEN coalesce(l.answer, '') <> '' THEN l.answer WHEN l.stop_cause = 'guardrail' THEN {v.lit(loops.FALLBACK_POLICY)}
    WHEN l.stop_cause = 'max iterations' THEN {v.lit(loops.FALLBACK_LIMIT)} ELSE '' END AS answer,
  l.stop_reason, l.stop_cause, CASE WHEN escalated_at IS NOT NULL THEN 'reasoning' ELSE l.tier END AS model_tier,
  CASE WHEN escalated_at IS NULL AND l.tier = 'fast' THEN {v.lit(CONFIG.fast_model_id)} ELSE {v.lit(CONFIG.reasoning_model_id)} END AS model_id,
  CASE WHEN escalated_at IS NOT NULL THEN 'escalation:' || c.cause ELSE l.reason END AS router_reason,
  CASE WHEN escalated_at IS NOT NULL THEN 'forced' ELSE l.source END AS router_source,
  CASE WHEN has_trace THEN 'intervened' END AS policy_action,
  l.i + 1 AS iterations, c.latency_ms, c.input_tokens, c.output_tokens, l.requested_at, l.tier, escalated_at IS NOT NULL AS escalated
  FROM looped l JOIN last_calls c ON c.request_id = l.request_id AND c.i = l.i)"""


@register("finalize_responses", f"""WITH {FINAL},
  {v.TOOL_RESULTS.replace(v.CALLS + ",", "")},
  stored AS (SELECT request_id, count(*) AS n_traces,
    string_agg(concat_ws(':', i, position, tool, input, status, output_preview), chr(30) ORDER BY i, position) AS traces
    FROM paired SEMI JOIN (SELECT request_id, i FROM looped WHERE is_tool AND NOT discarded) USING (request_id, i) GROUP BY 1),
  cited AS (SELECT request_id, session_id, 's3://docs/' || session_id AS citations FROM requests)
  SELECT request_id, session_id, answer, stop_reason, stop_cause, model_tier, model_id, router_reason, router_source, policy_action,
    iterations, latency_ms, input_tokens, output_tokens, coalesce(n_traces, 0) AS n_traces, coalesce(traces, '') AS traces, citations
  FROM final LEFT JOIN stored USING (request_id) LEFT JOIN cited USING (request_id)""")
def finalize_responses(spark, sf_dir):
    # Three branches read the run, so it is written once.
    run = materialize(looped(spark, sf_dir), "runs")
    usage = loops.usage_maps(loops.accumulate_usage(usage_of(run)))
    traces = loops.run_traces(run, paired_of(run, spark, sf_dir))
    asked = adapters.requests(spark, sf_dir)
    hits = asked.select("request_id", F.concat(F.lit("s3://docs/"), "session_id").alias("uri"), F.lit(1).alias("rank"))
    final = loops.finalize_responses(run, usage, traces, loops.run_citations(hits), config=CONFIG)
    line = lambda t: F.concat_ws(":", *[t[c].cast("string") for c in ("i", "position", "name", "input", "status", "output_preview")])
    return final.select(
        "request_id", "session_id", "answer", "stop_reason", "stop_cause", "model_tier", "model_id", "router_reason",
        "router_source", "policy_action", "iterations", "latency_ms",
        F.col("usage")["inputTokens"].alias("input_tokens"),
        F.col("usage")["outputTokens"].alias("output_tokens"),
        F.coalesce(F.size("tool_trace"), F.lit(0)).cast("bigint").alias("n_traces"),
        F.coalesce(F.array_join(F.transform("tool_trace", line), "\x1e"), F.lit("")).alias("traces"),
        F.array_join(F.transform("citations", lambda c: c["uri"]), " ").alias("citations"),
    )


_METRICS = FINAL + "," + v.TOOL_RESULTS.replace(v.CALLS + ",", "") + "," + v.ROUTED_LOG + "," + v.JOBS + """,
metrics AS (
  SELECT requested_at AS ts, 'AgentInvocations' AS name, 'Count' AS unit, 1 AS value FROM final
  UNION ALL SELECT requested_at, 'ModelTierFast', 'Count', 1 FROM final WHERE tier = 'fast'
  UNION ALL SELECT requested_at, 'ModelTierReasoning', 'Count', 1 FROM final WHERE tier = 'reasoning' OR escalated
  UNION ALL SELECT requested_at, 'RouterEscalations', 'Count', 1 FROM final WHERE escalated
  UNION ALL SELECT requested_at, 'GuardrailInterventions', 'Count', 1 FROM final WHERE stop_cause = 'guardrail'
  UNION ALL SELECT requested_at, 'AgentMaxIterations', 'Count', 1 FROM final WHERE stop_cause = 'max iterations'
  UNION ALL SELECT requested_at, 'AgentLatencyMs', 'Milliseconds', latency_ms FROM final
  UNION ALL SELECT requested_at, 'InputTokens', 'Count', input_tokens FROM final WHERE input_tokens <> 0
  UNION ALL SELECT requested_at, 'OutputTokens', 'Count', output_tokens FROM final WHERE output_tokens <> 0
  UNION ALL SELECT requested_at, CASE status WHEN 'success' THEN 'ToolSuccess' ELSE 'ToolErrors' END, 'Count', 1 FROM paired
  UNION ALL SELECT ts, 'Queries', 'Count', 1 FROM routed_log WHERE outcome = 200 AND route = 'POST /v1/query'
  UNION ALL SELECT ts, 'PresignedUploads', 'Count', 1 FROM routed_log WHERE outcome = 200 AND route = 'POST /v1/uploads/presign'
  UNION ALL SELECT ts, 'UnhandledErrors', 'Count', 1 FROM routed_log WHERE outcome = 500
  UNION ALL SELECT period, 'DocumentsUploaded', 'Count', uploaded FROM jobs
  UNION ALL SELECT period, 'IngestionJobsStarted', 'Count', started FROM jobs)"""


@register("metric_rollup", f"""WITH {_METRICS}
  SELECT date_trunc('hour', ts) AS period, name, unit, count(*) AS samples, CAST(sum(value) AS BIGINT) AS total,
    CAST(max(value) AS BIGINT) AS maximum FROM metrics GROUP BY 1, 2, 3""")
def metric_rollup(spark, sf_dir):
    calls = materialize(adapters.model_calls(spark, sf_dir), "calls")
    times = calls.filter(F.col("i") == 0).select("request_id", "requested_at")
    metrics = (
        operations.run_metrics(final_runs(loops.tool_loop(calls, CONFIG)))
        .unionByName(operations.tool_metrics(paired_of(calls, spark, sf_dir).join(times, "request_id")))
        .unionByName(operations.service_metrics(with_routes(adapters.access_log(spark, sf_dir))))
        .unionByName(operations.ingest_metrics(
            operations.ingestion_jobs(adapters.knowledge_documents(spark, sf_dir), "1 day")))
    )
    return operations.metric_rollup(metrics)


PRICES = {"fast": (0.001, 0.005), "reasoning": (0.003, 0.015)}


@register("cost_attribution", f"""WITH {FINAL},
  tagged AS (SELECT 'project-' || (CAST(request_id // 1000 AS BIGINT) % 7) AS project, model_tier AS tier, model_id, input_tokens, output_tokens FROM final)
  SELECT project, tier, model_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    round(sum(CASE tier WHEN 'fast' THEN input_tokens * 0.001 + output_tokens * 0.005
      ELSE input_tokens * 0.003 + output_tokens * 0.015 END) / 1000, 6) AS cost_usd
  FROM tagged GROUP BY ROLLUP (project, tier, model_id)""")
def cost_attribution(spark, sf_dir):
    project = F.concat(F.lit("project-"), F.pmod(F.floor(F.col("request_id") / 1000), F.lit(7)).cast("string"))
    usage = final_runs(looped(spark, sf_dir)).select(
        project.alias("project"), F.col("model_tier").alias("tier"), "model_id", "input_tokens", "output_tokens"
    )
    return operations.cost_attribution(usage, PRICES)
