"""Request routing: modality, complexity, tier cascade and model binding. No shuffle, no Python."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwire.config import CLASSIFIER_INPUT_CHARS, FAST, REASONING, EngineConfig
from groundwire.functions import strict_json
from groundwire.functions.routing import (
    LONG_QUERY_CHARS,
    RETRIEVAL_HINTS,
    case_folded,
    complexity_decision,
    decision,
)
from groundwire.functions.text import WHITESPACE_RANGES, compute_once, contains_any, strip, word_count
from groundwire.sources.requests import has_image

# Reasons and sources written by the cascade, and the classifier's defaults.
REASON_OVERRIDE = "client metadata override"
REASON_MODE = "ROUTER_MODE={mode}"
CLASSIFIER_CONFIDENCE = 0.7
CLASSIFIER_REASON = "llm classifier"
CLASSIFIER_PREFIX = "llm:"


def route_modality(requests: DataFrame) -> DataFrame:
    """Add modality, use_vision_model, suggest_vision_tool and suggest_retrieval."""
    image = has_image(requests)
    hinted = contains_any(F.lower(F.col("query")), RETRIEVAL_HINTS)
    return requests.withColumns({
        "modality": F.when(image & (strip(F.col("query")) != ""), "multimodal")
        .when(image, "image").otherwise("text"),
        "use_vision_model": image,
        "suggest_vision_tool": image,
        "suggest_retrieval": ~image | hinted,
    })


def classify_complexity(requests: DataFrame, name: str = "heuristic") -> DataFrame:
    """Add the rule verdict as a struct column (tier, reason, source, confidence)."""
    prepared = compute_once(requests, {"_stripped": strip(F.col("query"))})
    prepared = compute_once(prepared, {"_lowered": F.lower("_stripped")})
    # Longer texts are settled by their length, so their words are never counted.
    short = F.length("_stripped") <= LONG_QUERY_CHARS
    compact = strip(F.regexp_replace("_lowered", f"[^a-z{WHITESPACE_RANGES}']", ""))
    prepared = compute_once(prepared, {
        "_folded": case_folded(F.col("_stripped"), F.col("_lowered")),
        "_words": F.when(short, word_count(F.col("_lowered"))), "_compact": F.when(short, compact),
    })
    verdict = complexity_decision(
        *[F.col(c) for c in ("_stripped", "_lowered", "_folded", "_words", "_compact")], has_image(requests)
    )
    return compute_once(prepared, {name: verdict}).drop(
        "_stripped", "_lowered", "_folded", "_words", "_compact"
    )


def _override(requests: DataFrame) -> Column:
    wanted = F.lower(strip(F.try_element_at(F.col("metadata"), F.lit("model_tier"))))
    return F.when(wanted.isin(FAST, REASONING), decision(wanted, REASON_OVERRIDE, "override", 1.0))


def decide_tier(
    requests: DataFrame, config: EngineConfig = EngineConfig(), classified: DataFrame | None = None,
) -> DataFrame:
    """Add ``decision``: override, forced mode, confident rules, classifier verdict, else the rules.

    ``classified`` holds (request_id, verdict struct or null) for rows sent to the classifier; it
    has at most one row per request, so the join key is unique on both sides.
    """
    override = _override(requests)
    mode = config.router_mode
    if mode in ("reasoning_only", "fast_only"):
        tier = REASONING if mode == "reasoning_only" else FAST
        forced = decision(tier, REASON_MODE.format(mode=mode), "forced", 1.0)
        return requests.withColumn("decision", F.coalesce(override, forced))
    ruled = classify_complexity(requests, "_rule")
    rule = F.col("_rule")
    if mode == "heuristic" or classified is None:
        return ruled.withColumn("decision", F.coalesce(override, rule)).drop("_rule")
    verdicts = classified.select("request_id", F.col("verdict").alias("_verdict"))
    confident = F.when(rule.getField("confidence") >= config.confidence_floor, rule)
    return (
        ruled.join(verdicts, "request_id", "left")
        .withColumn("decision", F.coalesce(override, confident, F.col("_verdict"), rule))
        .drop("_rule", "_verdict")
    )


def classifier_candidates(requests: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Requests only the classifier can settle, with the prompt it gets."""
    image = has_image(requests)
    ruled = classify_complexity(requests, "_rule")
    undecided = ruled.filter(
        _override(requests).isNull() & (F.col("_rule.confidence") < config.confidence_floor)
    )
    if config.router_mode != "hybrid":
        undecided = undecided.filter(F.lit(False))
    prompt = F.concat(
        F.lit("Query: "), F.substring("query", 1, CLASSIFIER_INPUT_CHARS),
        F.lit("\nHas image: "), F.when(image, "True").otherwise("False"),
    )
    return undecided.select(
        "request_id", F.lit(config.fast_model_id).alias("model_id"), prompt.alias("prompt")
    )


def parse_classifier(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``verdict`` (null when unusable) and ``parse_error`` to classifier outputs.

    Accepts plain JSON, fenced JSON, and JSON inside prose. Confidence is not clamped. A value that
    is no object, or a confidence that is no number, makes the row unusable.
    """
    trimmed = strip(F.col(raw))
    bare = F.when(
        trimmed.startswith("```"),
        strip(F.regexp_replace(
            trimmed, rf"(?i)^```(?:json)?[{WHITESPACE_RANGES}]*|[{WHITESPACE_RANGES}]*```$", ""
        )),
    ).otherwise(trimmed)
    sliced = F.regexp_extract(F.col("_bare"), r"(?s)\{.*\}", 0)
    parsed = compute_once(outputs, {"_bare": bare})
    parsed = compute_once(
        parsed, {"_json": F.coalesce(strict_json.parse(F.col("_bare")), strict_json.parse(sliced))}
    )
    json = F.col("_json")
    confidence = strict_json.member(json, "$.confidence")
    number = strict_json.member(json, "$.confidence", "double")
    kind = strict_json.kind(confidence)
    empty_text = F.coalesce(strict_json.member(json, "$.confidence", "string") == "", F.lit(False))
    score = F.when(
        kind.isNull() | (kind == "VOID") | empty_text | (F.coalesce(number, F.lit(1.0)) == 0.0)
        & (kind != "STRING"),
        F.lit(CLASSIFIER_CONFIDENCE),
    ).otherwise(number)
    reason = F.coalesce(
        F.when(strict_json.member(json, "$.reason", "string") != "",
               strict_json.member(json, "$.reason", "string")),
        F.lit(CLASSIFIER_REASON),
    )
    tier = F.lower(strict_json.member(json, "$.tier", "string"))
    is_object = F.coalesce(strict_json.kind(json) == "OBJECT", F.lit(False))
    known_tier = F.coalesce(tier.isin(FAST, REASONING), F.lit(False))
    error = (
        F.when(json.isNull(), "no JSON")
        .when(~is_object, "not an object")
        .when(~known_tier, "unknown tier")
        .when(score.isNull(), "confidence is no number")
    )
    checked = compute_once(parsed, {"parse_error": error})
    verdict = F.when(
        F.col("parse_error").isNull(),
        decision(tier, F.concat(F.lit(CLASSIFIER_PREFIX), reason), "llm", score),
    )
    return checked.withColumn("verdict", verdict).drop("_bare", "_json")


def bind_models(decisions: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add the model id of the tier; two literals, so no join is needed."""
    return decisions.withColumn(
        "model_id",
        F.when(F.col("decision.tier") == FAST, config.fast_model_id)
        .otherwise(config.bound_reasoning_model),
    )


# The intended share of requests per tier.
TARGET_SHARE = {FAST: 0.75, REASONING: 0.25}


def tier_share(decisions: DataFrame, targets: Mapping[str, float] = TARGET_SHARE) -> DataFrame:
    """Requests per tier, source and reason with every subtotal (null = all), share, and distance to target.

    Counts requests, not tier metrics: an escalated request would emit two of those. The target
    applies to a tier over all sources and reasons. Requests are counted before the cube, so only
    their few distinct decisions are expanded.
    """
    each = decisions.groupBy("decision.tier", "decision.source", "decision.reason").agg(F.count("*").alias("_n"))
    counted = each.cube("tier", "source", "reason").agg(
        F.sum("_n").alias("requests"), F.grouping_id().alias("_level")
    )
    total = F.sum(F.when(F.col("_level") == 7, F.col("requests")))
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("tier"))
    # The window runs over the few subtotal rows, not over requests.
    shared = counted.withColumn("_share", F.col("requests") / total.over(Window.partitionBy()))
    return shared.select(
        "tier", "source", "reason", "requests", F.col("_share").alias("share"),
        F.when(F.col("_level") == 3, F.col("_share") - target).alias("over_target"),
    )
