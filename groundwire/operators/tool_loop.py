"""Rebuild agent runs from model-call logs: escalation, stop cause, final response, usage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwire.config import FAST, REASONING, EngineConfig
from groundwire.functions.routing import low_confidence
from groundwire.functions.text import strip

# Escalation reasons, stop reasons and fallback texts.
ESCALATE_TOOLS = "complex or multi-step tool use"
ESCALATE_ANSWER = "low-confidence fast-tier answer"
ESCALATION_PREFIX = "escalation:"
STOP_TOOL = "tool_use"
STOP_POLICY = "guardrail_intervened"
STOP_DEFAULT = "end_turn"
FALLBACK_POLICY = "The safety guardrail blocked this turn. Please rephrase."
FALLBACK_LIMIT = "Reached the tool-iteration limit before a final answer."
POLICY_ACTION_DEFAULT = "intervened"
VISION_TOOL = "analyze_image"


def _null_safe(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def tool_loop(calls: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add per call: effective tier, the escalation it triggers, and the run's stop cause.

    Input: one row per (request_id, i), i counting model calls from 0, with stop_reason, tools (the
    names called), answer and the initial ``tier``. Rows past the iteration limit or past the stop
    are not part of a run and are dropped. The windows run per request and see at most
    ``max_tool_iterations`` rows each; one exchange by request_id serves all of them.
    """
    run = Window.partitionBy("request_id")
    is_tool = _null_safe(F.col("stop_reason") == STOP_TOOL)
    is_policy = _null_safe(F.col("stop_reason") == STOP_POLICY)
    complex_tools = (
        _null_safe(F.array_contains("tools", VISION_TOOL))
        | (F.col("i") >= 1) | (_null_safe(F.size("tools") > 1))
    )
    cause = F.when(is_policy, None).when(is_tool & complex_tools, ESCALATE_TOOLS).when(
        ~is_tool & _null_safe(low_confidence(F.col("answer"))), ESCALATE_ANSWER
    )
    may_escalate = (F.col("tier") == FAST) & F.lit(config.escalate_on_tools)
    flagged = calls.filter(F.col("i").between(0, config.max_tool_iterations - 1)).withColumns({
        "_tool": is_tool, "_policy": is_policy, "_cause": F.when(may_escalate, cause),
    })
    # The first call that would escalate counts only if nothing stopped the run before it.
    first = flagged.withColumn("_candidate", F.min(F.when(F.col("_cause").isNotNull(), F.col("i"))).over(run))
    ends = F.col("_policy") | (~F.col("_tool") & F.col("_cause").isNull())
    first = first.withColumn("_early_stop", F.min(F.when(ends, F.col("i"))).over(run))
    escalates_at = F.when(
        F.col("_early_stop").isNull() | (F.col("_candidate") < F.col("_early_stop")), F.col("_candidate")
    )
    staged = first.withColumn("escalated_at", escalates_at)
    after = F.col("_policy") | ~F.col("_tool")
    stops_at = F.when(
        F.col("escalated_at").isNull(), F.col("_early_stop")
    ).otherwise(F.min(F.when(after & (F.col("i") > F.col("escalated_at")), F.col("i"))).over(run))
    stopped = staged.withColumn("stopped_at", stops_at).filter(
        F.col("stopped_at").isNull() | (F.col("i") <= F.col("stopped_at"))
    )
    escalated = F.col("escalated_at").isNotNull()
    at_stop = F.max(F.when((F.col("i") == F.col("stopped_at")) & F.col("_policy"), F.lit(True)))
    stop_cause = (
        F.when(_null_safe(at_stop.over(run)), "guardrail")
        .when(F.col("stopped_at").isNotNull(), "answered")
        .when(F.max("i").over(run) == config.max_tool_iterations - 1, "max iterations")
        .otherwise("incomplete")
    )
    return stopped.withColumns({
        "effective_tier": F.when(escalated & (F.col("i") > F.col("escalated_at")), REASONING)
        .otherwise(F.col("tier")),
        "escalation": F.when(F.col("i") == F.col("escalated_at"), F.col("_cause")),
        "discarded": _null_safe(F.col("i") == F.col("escalated_at")),
        "stop_cause": stop_cause,
    }).drop("_tool", "_policy", "_cause", "_candidate", "_early_stop")


def escalation_report(looped: DataFrame) -> DataFrame:
    """Escalations by cause and original routing reason, with the rate over fast starts."""
    per_reason = looped.filter((F.col("i") == 0) & (F.col("tier") == FAST)).groupBy("reason").agg(
        F.count("*").alias("fast_starts")
    )
    escalated = looped.filter(F.col("escalation").isNotNull()).groupBy("reason", "escalation").agg(
        F.count("*").alias("escalations")
    )
    # Both sides hold one row per reason and cause by now.
    return escalated.join(per_reason, "reason").select(
        "reason", F.col("escalation").alias("cause"), "escalations", "fast_starts",
        (F.col("escalations") / F.col("fast_starts")).alias("rate"),
    )


def accumulate_usage(calls: DataFrame) -> DataFrame:
    """Usage counters summed per request; each value is cut to an integer before adding.

    ``usage`` maps names to variants; entries that are no number are ignored, text that looks like one
    included. Whole numbers stay exact.
    """
    entries = calls.select("request_id", F.explode("usage").alias("key", "value"))
    kind = F.schema_of_variant("value")
    whole = F.try_variant_get("value", "$", "bigint")
    cut = F.try_variant_get("value", "$", "double").try_cast("bigint")
    number = F.when(kind == "BIGINT", whole).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), cut)
    return (
        entries.select("request_id", "key", number.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("request_id", "key")
        .agg(F.sum("value").alias("value"))
    )


def usage_maps(usage: DataFrame) -> DataFrame:
    """One map per request; its size is the number of distinct counters, not of calls."""
    return usage.groupBy("request_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("usage")
    )


def run_traces(looped: DataFrame, paired: DataFrame) -> DataFrame:
    """Traces of the tools a run really executed, in call order; a discarded turn runs none.

    ``paired`` numbers the calls of a turn in ``position``. The iteration limit and the calls of a turn bound
    the array.
    """
    executed = looped.filter((F.col("stop_reason") == STOP_TOOL) & ~F.col("discarded")).select("request_id", "i").distinct()
    traced = paired.join(executed, ["request_id", "i"])
    for name, missing in (("position", F.lit(0).cast("bigint")), ("input", F.lit(None).cast("string"))):
        if name not in traced.columns:
            traced = traced.withColumn(name, missing)
    trace = F.struct("i", "position", F.col("tool").alias("name"), "input", "status", "output_preview")
    return traced.groupBy("request_id").agg(F.sort_array(F.collect_list(trace)).alias("tool_trace"))


def run_citations(hits: DataFrame, order: Sequence[str] = ("rank",)) -> DataFrame:
    """Citations of a request in ``order``, from retrieval hits (request_id, rank, ...); at most ten per search, and
    the iteration limit bounds the searches of a run. Maps are no part of the order."""
    maps = [name for name, kind in hits.dtypes if kind.startswith("map<")]
    others = [c for c in hits.columns if c not in ("request_id", *order)]
    # Maps can't be sorted, so they travel as their entries.
    entries = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in others]
    cited = F.sort_array(F.collect_list(F.struct(*order, *entries)))

    def with_maps(citation: Column) -> Column:
        for name in maps:
            citation = citation.withField(name, F.map_from_entries(citation[name]))
        return citation

    if maps:
        cited = F.transform(cited, with_maps)
    return hits.groupBy("request_id").agg(cited.alias("citations"))


def finalize_responses(
    looped: DataFrame, usage: DataFrame | None = None, traces: DataFrame | None = None,
    citations: DataFrame | None = None, config: EngineConfig = EngineConfig(),
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One response row per request from the last call of its run.

    ``traces`` and ``citations`` are grouped per request (a run is bounded by the iteration limit).
    An absent stop reason becomes the default, an empty text the fallback of its stop cause.
    ``totals`` are further aggregates over a run's calls, computed in the same pass.
    """
    totals = totals or {}
    last = looped.groupBy("request_id").agg(
        F.max_by(F.struct("stop_reason", "answer", "stop_cause", "tier", "reason", "source",
                          "escalated_at", "effective_tier", "policy_trace"), F.col("i")).alias("_last"),
        *([F.min("session_id").alias("session_id")] if "session_id" in looped.columns else []),
        F.max("i").alias("_i"),
        F.sum("latency_ms").cast("bigint").alias("latency_ms"),
        F.max("escalation").alias("_cause"),
        *[total.alias(name) for name, total in totals.items()],
    )
    text = strip(F.coalesce(F.col("_last.answer"), F.lit("")))
    fallback = (
        F.when(F.col("_last.stop_cause") == "guardrail", FALLBACK_POLICY)
        .when(F.col("_last.stop_cause") == "max iterations", FALLBACK_LIMIT)
        .otherwise("")
    )
    escalated = F.col("_last.escalated_at").isNotNull()
    tier = F.when(escalated, REASONING).otherwise(F.col("_last.tier"))
    trace = F.col("_last.policy_trace")
    final = last.select(
        "request_id", *(["session_id"] if "session_id" in looped.columns else []),
        F.when(text != "", text).otherwise(fallback).alias("answer"),
        F.coalesce(F.when(F.col("_last.stop_reason") != "", F.col("_last.stop_reason")),
                   F.lit(STOP_DEFAULT)).alias("stop_reason"),
        F.col("_last.stop_cause").alias("stop_cause"),
        tier.alias("model_tier"),
        F.when(tier == FAST, config.fast_model_id).otherwise(config.bound_reasoning_model).alias("model_id"),
        F.when(escalated, F.concat(F.lit(ESCALATION_PREFIX), F.col("_cause")))
        .otherwise(F.col("_last.reason")).alias("router_reason"),
        F.when(escalated, "forced").otherwise(F.col("_last.source")).alias("router_source"),
        F.when(trace.isNotNull(), F.coalesce(F.when(trace["action"] != "", trace["action"]),
                                             F.lit(POLICY_ACTION_DEFAULT))).alias("policy_action"),
        (F.col("_i") + 1).alias("iterations"),
        "latency_ms", *totals,
    )
    for extra in (usage, traces, citations):
        if extra is not None:
            final = final.join(extra, "request_id", "left")
    return final
