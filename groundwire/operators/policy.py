"""Content policy: masking, denied topics, content scores, and the sensitive-data scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.functions import sensitive
from groundwire.functions.text import contains_any
from groundwire.operators.phrases import Lists, mask_phrases

# Categories with their (input, output) strength, and the texts that replace blocked ones.
CATEGORY_STRENGTH = {
    "HATE": ("HIGH", "HIGH"), "INSULTS": ("HIGH", "HIGH"), "SEXUAL": ("HIGH", "HIGH"),
    "VIOLENCE": ("HIGH", "HIGH"), "MISCONDUCT": ("HIGH", "HIGH"), "PROMPT_ATTACK": ("HIGH", "NONE"),
}
BLOCKED_INPUT = "This request was blocked by the safety guardrail. Rephrase without prohibited content."
BLOCKED_OUTPUT = "The generated response was blocked by the safety guardrail."
# Score from which a strength blocks; NONE never does. The scores come from an external classifier.
STRENGTH_THRESHOLD: Mapping[str, float | None] = {"HIGH": 0.5, "MEDIUM": 0.7, "LOW": 0.9, "NONE": None}
# Denied topics; their terms follow the definitions and example questions.
DENIED_TOPICS: Mapping[str, Sequence[str]] = {
    "Weapons and explosives": (
        "weapon", "explosive", "bomb", "firearm", "violent instrument",
    ),
    "Cyber attacks": (
        "unauthorized access", "malware", "exploit", "ransomware", "hack this", "hack into",
        "attacking systems",
    ),
}


#: Types that no pattern finds; their phrases come from lists of the caller.
LISTED = tuple(entity for entity in sensitive.ENTITY_TYPES if entity not in sensitive.PATTERNS)


def _mask(text: Column, names: Sequence[str], addresses: Sequence[str], lists: Lists | None) -> Column:
    """Patterns first, then phrases as whole words: ``lists`` (columns entity and phrase, any number of rows) or the
    two short lists."""
    masked = sensitive.mask(text)
    if lists is None:
        lists = {entity: own for entity, own in zip(("NAME", "ADDRESS"), (names, addresses)) if own}
    return masked if isinstance(lists, dict) and not lists else mask_phrases(masked, lists, LISTED)


def anonymize(
    df: DataFrame, column: str, *, names: Sequence[str] = (), addresses: Sequence[str] = (), lists: Lists | None = None,
) -> DataFrame:
    """Add ``masked`` and ``anonymized`` for ``column``; one row-local pass, no shuffle."""
    masked = df.withColumn("masked", _mask(F.col(column), names, addresses, lists))
    return masked.withColumn("anonymized", F.col("masked") != F.col(column))


def screen_topics(
    df: DataFrame, column: str, topics: Mapping[str, Sequence[str]] = DENIED_TOPICS
) -> DataFrame:
    """Add ``topics``: the denied topics whose terms occur in the text, in declared order."""
    lowered = F.lower(F.col(column))
    flags = [F.when(contains_any(F.col("_lowered"), terms), topic) for topic, terms in topics.items()]
    return df.withColumn("_lowered", lowered).withColumn(
        "topics", F.array_compact(F.array(*flags))
    ).drop("_lowered")


def _threshold(
    category: Column, direction: Column, strengths: Mapping[str, tuple[str, str]],
    thresholds: Mapping[str, float | None],
) -> Column:
    entries = []
    for name, (on_input, on_output) in strengths.items():
        for side, strength in (("input", on_input), ("output", on_output)):
            if thresholds[strength] is not None:
                entries += [F.lit(f"{name}/{side}"), F.lit(float(thresholds[strength]))]
    return F.try_element_at(F.create_map(*entries), F.concat(category, F.lit("/"), direction))


def screen_content(
    scores: DataFrame, strengths: Mapping[str, tuple[str, str]] = CATEGORY_STRENGTH,
    thresholds: Mapping[str, float | None] = STRENGTH_THRESHOLD,
) -> DataFrame:
    """(item_id, category, direction, score) to one verdict per item and direction."""
    limit = _threshold(F.col("category"), F.col("direction"), strengths, thresholds)
    over = F.coalesce(F.col("score") >= limit, F.lit(False))
    return scores.groupBy("item_id", "direction").agg(
        F.bool_or(over).alias("blocked"),
        F.count_if(over).alias("categories_over"),
        F.max("score").alias("max_score"),
    )


def apply_policy(
    texts: DataFrame, verdicts: DataFrame, direction: str = "input", *,
    topics: Mapping[str, Sequence[str]] = DENIED_TOPICS, names: Sequence[str] = (),
    addresses: Sequence[str] = (), lists: Lists | None = None,
) -> DataFrame:
    """(item_id, text) with content verdicts to an action and the text that may pass on."""
    blocked_ids = verdicts.filter((F.col("direction") == direction) & F.col("blocked")).select(
        "item_id", F.lit(True).alias("_blocked")
    )
    screened = screen_topics(texts, "text", topics).join(blocked_ids, "item_id", "left")
    blocked = F.col("_blocked").isNotNull() | (F.size("topics") > 0)
    # Blocked texts are replaced, so only the others need masking.
    masked = F.when(~blocked, _mask(F.when(~blocked, F.col("text")), names, addresses, lists))
    message = BLOCKED_INPUT if direction == "input" else BLOCKED_OUTPUT
    done = screened.withColumn("_masked", masked).withColumn("_is_blocked", blocked)
    return done.withColumns({
        "action": F.when(F.col("_is_blocked"), "blocked")
        .when(F.col("_masked") != F.col("text"), "anonymized").otherwise("none"),
        "output_text": F.when(F.col("_is_blocked"), message).otherwise(F.col("_masked")),
    }).drop("_masked", "_blocked", "_is_blocked")


def action_counts(policed: DataFrame) -> DataFrame:
    return policed.groupBy("action").agg(F.count("*").alias("items"))


def pii_matches(objects: DataFrame, column: str = "text") -> DataFrame:
    """(bucket, object_id, text) to one row per object and entity type found, with match counts.

    All types are searched in one pass over the text; the text leaves the plan before any shuffle.
    """
    counts = [
        F.struct(
            F.lit(entity).alias("entity"), F.lit(sensitive.SEVERITY[entity]).alias("severity"),
            F.coalesce(F.size(sensitive.matches(F.col(column), entity)), F.lit(0)).cast("bigint").alias("matches"),
        )
        for entity in sensitive.ENTITY_TYPES if entity in sensitive.PATTERNS
    ]
    return objects.select(
        "bucket", "object_id", F.inline(F.filter(F.array(*counts), lambda c: c["matches"] > 0))
    )


def pii_findings(objects: DataFrame, column: str = "text") -> DataFrame:
    return summarize_findings(pii_matches(objects, column))


def summarize_findings(matches: DataFrame) -> DataFrame:
    return matches.groupBy("bucket", "entity", "severity").agg(
        F.count("*").alias("objects"), F.sum("matches").alias("matches")
    )
