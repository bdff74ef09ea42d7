"""Conversation turns, tool results and cited answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwire.config import PREVIEW_CHARS
from groundwire.functions.routing import low_confidence
from groundwire.plans.skew import salted_join

#: Turn numbers a task looks at together.
TURN_BLOCK = 64
# Tools an agent run may call, URIs an answer may cite.
KNOWN_TOOLS = ("analyze_image", "retrieve_knowledge")
URI_PATTERN = r"s3://[A-Za-z0-9._/-]*[A-Za-z0-9_/-]"


def pair_turns(turns: DataFrame) -> DataFrame:
    """Each user turn with the next assistant turn of its session, whatever lies between; others stay unanswered.

    The next assistant turn is the one of the smallest greater turn number; of several on that number the one with
    the smallest text answers. Every user turn gives one row, also those that share a number; a user turn without
    number or session stays unanswered, and an assistant turn without them answers nothing.

    The next assistant turn is found on turn numbers alone, within blocks of TURN_BLOCK of them; only a block's
    first assistant turn is looked up by the blocks before it. Texts are joined on (session, turn) afterwards, so
    no session, however long, is gathered into one task.
    """
    key = ["session_id", "turn"]
    asked = turns.filter(F.col("role") == "user").select(*key, F.col("text").alias("question"))
    placed = F.col("session_id").isNotNull() & F.col("turn").isNotNull()
    said = turns.filter(placed).groupBy(*key).agg(
        F.bool_or(F.col("role") == "user").alias("_asks"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_said")
    ).withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    after = Window.partitionBy("session_id", "_block").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    firsts = said.groupBy("session_id", "_block").agg(F.min("_said").alias("_first"))
    later = Window.partitionBy("session_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    beyond = firsts.select("session_id", "_block", F.min("_first").over(later).alias("_beyond"))
    within = said.withColumn("_next", F.min("_said").over(after)).filter("_asks")
    found = salted_join(within, beyond, ["session_id", "_block"], [F.col("turn")]).select(
        *key, F.coalesce("_next", "_beyond").alias("answer_turn")
    )
    answers = turns.filter(placed & (F.col("role") == "assistant")).groupBy("session_id", F.col("turn").alias("answer_turn")).agg(
        F.min("text").alias("answer"), F.lit(True).alias("_found")
    )
    return asked.join(found, key, "left").join(answers, ["session_id", "answer_turn"], "left").select(
        "session_id", "turn", "question", "answer", F.col("_found").isNotNull().alias("answered")
    )


def message_blocks(turns: DataFrame, block_turns: int = TURN_BLOCK) -> DataFrame:
    """Storage form of message lists: blocks of ``block_turns`` consecutive turn numbers, each in order. An array
    never grows with its session."""
    block = F.floor(F.col("turn") / block_turns).cast("bigint")
    return (
        turns.groupBy("session_id", block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
        .withColumn("n_messages", F.size("messages").cast("bigint"))
    )


def assemble_messages(turns: DataFrame) -> DataFrame:
    """The ordered message list of every run: one row per session, whatever its length.

    A run is bounded by its iteration limit; endless sessions are better kept as ``message_blocks``, from
    which the lists are put together here.
    """
    block = F.struct("block", "messages")
    return message_blocks(turns).groupBy("session_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["messages"])).alias("messages"),
        F.sum("n_messages").alias("n_messages"),
    )


def low_confidence_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("low_confidence", low_confidence(F.col("answer")))


def pair_tool_results(
    calls: DataFrame, results: DataFrame, tools: Sequence[str] = KNOWN_TOOLS
) -> DataFrame:
    """One row per tool call with status, full-length result and its preview.

    The tool-use id is unique, so neither side of the join has a hot key. Unknown tools and calls
    without a result are errors.
    """
    known = F.col("tool").isin(*tools)
    paired = calls.join(
        results.select("request_id", "tool_use_id", "result"), ["request_id", "tool_use_id"], "left"
    )
    failure = F.when(~known, F.concat(F.lit("Unknown tool: "), F.col("tool"))).when(
        F.col("result").isNull(), "no result"
    )
    output = F.when(failure.isNull(), F.col("result")).otherwise(
        F.to_json(F.struct(failure.alias("error")))
    )
    carried = [c for c in ("position", "input") if c in calls.columns]
    return paired.select(
        "request_id", "i", *carried, "tool_use_id", "tool",
        F.when(failure.isNull(), "success").otherwise("error").alias("status"),
        F.substring(output, 1, PREVIEW_CHARS).alias("output_preview"),
    )


def tool_stats(paired: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("status") == "error")
    return paired.groupBy("tool").agg(
        F.count("*").alias("calls"), errors.alias("errors"),
        (errors / F.count("*")).alias("error_rate"),
    )


def citation_grounding(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Per answer: cited URIs, those the session never retrieved, and a verdict.

    The join is salted by answer, since one session and URI may occur in very many answers.
    """
    mentions = answers.select(
        "answer_id", "session_id",
        F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(URI_PATTERN), F.lit(0)))).alias("uri"),
    )
    allowed = citations.select("session_id", "uri", F.lit(True).alias("_known")).distinct()
    checked = salted_join(mentions, allowed, ["session_id", "uri"], [F.col("answer_id")])
    per_answer = checked.groupBy("answer_id").agg(
        F.count("*").alias("cited"),
        F.count_if(F.col("_known").isNull()).alias("ungrounded"),
    )
    return answers.select("answer_id", "session_id").join(per_answer, "answer_id", "left").select(
        "answer_id", "session_id",
        F.coalesce("cited", F.lit(0)).alias("cited"),
        F.coalesce("ungrounded", F.lit(0)).alias("ungrounded"),
        F.when(F.col("cited").isNull(), "no citation")
        .when(F.col("ungrounded") > 0, "ungrounded").otherwise("grounded").alias("verdict"),
    )
