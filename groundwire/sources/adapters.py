"""Views that give the test tables the shape of assistant traffic.

Every view covers its whole source table; ``plans/oracle_views.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.operators.routing import classify_complexity

START = "2024-01-01 00:00:00"
EXTENSIONS = ("md", "PDF", "html", "tar.gz", "csv", "", "png")


#: Set by ``local_session``: the test files have one row group each, which no setting of Spark's can split.
SCAN_PARTITIONS = "spark.groundwire.scanPartitions"
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Sessions that ask for it get the long texts dealt over so many partitions; on a cluster the
    setting stays unset and tables are read as they are stored."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(wanted)) if wanted and name in TEXT_TABLES else rows


def _minutes_after_start(minutes):
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests, dressed so that every routing rule sees traffic."""
    return requests_of(table(spark, sf_dir, "conversations"))


def requests_of(turns: DataFrame) -> DataFrame:
    user = turns.filter(F.col("role") == "user")
    kind = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(8))
    conv = F.col("conv_id").cast("string")
    return user.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        conv.alias("session_id"), "conv_id", "turn",
        F.when(kind == 0, "hello there")
        .when(kind == 1, F.concat(F.lit("What is item "), conv, F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Compare "), F.col("text")))
        .when(kind == 3, F.concat(F.lit("Write a function for "), F.col("text")))
        .when(kind == 4, F.concat(F.col("text"), F.lit("? "), F.col("text"), F.lit("?")))
        .otherwise(F.col("text")).alias("query"),
        F.when(kind == 5, F.struct(
            F.lit("uploads").alias("bucket"),
            F.concat(F.lit("uploads/"), conv, F.lit(".png")).alias("key"),
        )).alias("image"),
        F.when(kind == 6, F.create_map(F.lit("model_tier"), F.lit("reasoning")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        _minutes_after_start(F.col("conv_id") * 60 + F.col("turn")).alias("requested_at"),
    )


def classifier_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw classifier texts per request: plain, fenced, in prose, and several unusable forms."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    good = '{"tier":"fast","confidence":0.81,"reason":"simple ask"}'
    return requests(spark, sf_dir).select(
        "request_id",
        F.when(kind == 0, good)
        .when(kind == 1, f"```json\n{good}\n```")
        .when(kind == 2, F.concat(F.col("query"), F.lit(f" {good} "), F.col("query")))
        .when(kind == 3, '{"tier":"medium","confidence":0.9}')
        .when(kind == 4, '[{"tier":"fast"}]')
        .when(kind == 5, '{"tier":"REASONING","confidence":0}')
        .when(kind == 6, '{"tier":"fast","confidence":"high"}')
        .when(kind == 7, F.concat(F.lit('{"tier":"reasoning","confidence":1.5,"reason":"turn '),
                                  F.col("turn").cast("string"), F.lit('"}')))
        .otherwise(F.col("query")).alias("raw"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    conv = F.col("conv_id").cast("string")
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return said.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), conv.alias("session_id"),
        F.when(kind == 0, F.concat(F.lit("I'm not sure. "), F.col("text")))
        .when(kind == 1, F.concat(F.col("text"), F.lit(" Sources: s3://docs/"), conv))
        .when(kind == 2, F.concat(F.col("text"), F.lit(" Sources: s3://missing/"), conv))
        .otherwise(F.col("text")).alias("answer"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("session_id"), F.concat(F.lit("s3://docs/"), conv).alias("uri")
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls of every request: m tool turns, then a final answer, then one more after a doubt."""
    routed = classify_complexity(requests(spark, sf_dir), "_d")
    c, t, i = F.col("conv_id"), F.col("turn"), F.col("i")
    m = F.pmod(c * 3 + t, F.lit(8))
    doubt = F.pmod(c + t, F.lit(3)) == 0
    policy = F.pmod(c + t, F.lit(6)) == 0
    tool_kind = F.pmod(c + t + i, F.lit(5))
    tool = F.when(tool_kind == 0, "analyze_image").when(tool_kind == 4, "unknown_tool").otherwise(
        "retrieve_knowledge"
    )
    is_tool = i < m
    name = F.when(is_tool, tool)
    return (
        routed.withColumn("_m", m)
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(5), m + F.when(doubt, 1).otherwise(0)))))
        .select(
            "request_id", "session_id", "i", "requested_at",
            F.when(is_tool, "tool_use").when((i == m) & policy, "guardrail_intervened")
            .otherwise("end_turn").alias("stop_reason"),
            name.alias("tool"),
            F.when(is_tool, F.when(F.pmod(c + t + i, F.lit(6)) == 0, F.array(name, name)).otherwise(F.array(name)))
            .otherwise(F.array().cast("array<string>")).alias("tools"),
            F.when(is_tool, F.concat(F.col("request_id").cast("string"), F.lit("-"), i.cast("string")))
            .alias("tool_use_id"),
            F.when(~is_tool & ~((i == m) & policy), F.when((i == m) & doubt, "I'm not sure.").otherwise("Done."))
            .alias("answer"),
            (i + 10).alias("input_tokens"), ((i + 1) * 5).alias("output_tokens"),
            ((c + t + i) * 37).alias("latency_ms"),
            F.col("_d.tier").alias("tier"), F.col("_d.reason").alias("reason"),
            F.col("_d.source").alias("source"),
            F.when((i == m) & policy, F.struct(F.lit(None).cast("string").alias("action"))).alias("policy_trace"),
        )
    )


def tool_calls_of(calls: DataFrame) -> DataFrame:
    """One row per tool a turn asked for; the second call of a turn goes to the other known tool."""
    asked = calls.filter(F.col("tool_use_id").isNotNull()).select(
        "request_id", "i", "requested_at", "tool_use_id", F.posexplode("tools").alias("position", "tool")
    )
    position = F.col("position")
    other = F.when(F.col("tool") == "retrieve_knowledge", "analyze_image").otherwise("retrieve_knowledge")
    return asked.select(
        "request_id", "i", "requested_at", position.cast("bigint").alias("position"),
        F.when(position == 0, F.col("tool_use_id")).otherwise(F.concat("tool_use_id", F.lit("b"))).alias("tool_use_id"),
        F.when(position == 0, F.col("tool")).otherwise(other).alias("tool"),
        F.concat(F.lit('{"call":'), position.cast("string"), F.lit("}")).alias("input"),
    )


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_results_of(tool_calls_of(model_calls(spark, sf_dir)), table(spark, sf_dir, "conversations"))


def tool_results_of(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Results exist for calls of sessions that hold an assistant turn right after the request."""
    answered = turns.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("request_id")
    )
    return calls.join(answered, "request_id", "left_semi").select(
        "request_id", "tool_use_id", F.concat(F.lit("result "), F.col("tool_use_id")).alias("result")
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_of(table(spark, sf_dir, "events"))


def access_log_of(events: DataFrame) -> DataFrame:
    path = F.pmod(F.col("event_id"), F.lit(5))
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("caller"), "ts",
        F.lit("post").alias("method"),
        F.when(path == 0, "/prod/v1/query/").when(path == 1, "/prod/v1/health")
        .when(path == 2, "/v1/uploads/presign").when(path == 3, "/prod/v1/ingest")
        .otherwise("/prod/unknown").alias("path"),
        F.lit("prod").alias("stage"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429)
        .otherwise(200).cast("bigint").alias("status"),
        F.round(F.col("value") * 200).cast("bigint").alias("latency_ms"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored object versions; several versions share a key."""
    return objects_of(table(spark, sf_dir, "documents"))


def objects_of(documents: DataFrame) -> DataFrame:
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    prefix = F.when(kind == 0, "knowledge/").when(kind == 1, "uploads/").otherwise("logs/")
    return documents.select(
        F.when(kind == 0, "documents").when(kind == 1, "uploads")
        .when(F.col("lang") == "en", "log-groups").otherwise("logs").alias("bucket"),
        F.concat(prefix, F.col("lang"), F.lit("/"), F.pmod(F.col("n_chars"), F.lit(40)).cast("string")).alias("key"),
        F.col("doc_id").alias("version_id"),
        _minutes_after_start(F.pmod(F.col("doc_id"), F.lit(120)) * 1440 + F.pmod(F.col("doc_id"), F.lit(1440))).alias("created"),
        F.when(F.pmod(F.col("doc_id"), F.lit(4)) == 2, "incomplete").otherwise("stored").alias("state"),
        F.col("n_chars").alias("size"),
    )


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_documents_of(table(spark, sf_dir, "documents"))


def knowledge_documents_of(documents: DataFrame) -> DataFrame:
    """Documents with a unique key under one of three prefixes."""
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    prefix = F.when(kind == 0, "knowledge/").when(kind == 1, "uploads/").otherwise("logs/")
    key = F.concat(prefix, F.col("doc_id").cast("string"))
    return documents.select(
        "doc_id", "source", key.alias("key"),
        F.concat(F.lit("s3://"), F.col("source"), F.lit("/"), key).alias("uri"), "text",
        _minutes_after_start(F.pmod(F.col("doc_id"), F.lit(120)) * 1440 + F.pmod(F.col("doc_id"), F.lit(1440))).alias("ts"),
    )


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s3://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("uri"),
        "source", "text",
    )


def content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as classifier scores: toxicity on input, a prompt-attack score on both directions."""
    labels = table(spark, sf_dir, "labels")
    toxic, quality = F.col("toxic").cast("double"), F.col("quality").cast("double")
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(d).alias("direction"), s.alias("score"))
        for c, d, s in (
            ("INSULTS", "input", toxic), ("PROMPT_ATTACK", "input", (1 - quality) * 0.4),
            ("PROMPT_ATTACK", "output", toxic), ("HATE", "output", toxic * 0.5),
        )
    ])
    return labels.select(F.col("doc_id").alias("item_id"), F.inline(rows))


def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as image bytes behind format marks, and documents as inline base64 payloads."""
    marks = ("89504E470D0A1A0A", "FFD8FF", "474946383961", "52494646000000005745425056503820", "52494646")
    kind = F.pmod(F.col("page_id"), F.lit(6))
    head = F.when(kind == 0, F.unhex(F.lit(marks[0])))
    for n, mark in enumerate(marks[1:], start=1):
        head = head.when(kind == n, F.unhex(F.lit(mark)))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("image_id"),
        F.concat(head.otherwise(F.unhex(F.lit(""))), F.encode("html", "utf-8")).alias("content"),
        F.lit(None).cast("string").alias("image_base64"), F.lit(None).cast("string").alias("image_format"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("image_id"),
        F.lit(None).cast("binary").alias("content"),
        F.concat(
            F.when(F.col("lang") == "en", "data:image/png;base64,").otherwise(""),
            F.base64(F.encode("text", "utf-8")),
        ).alias("image_base64"),
        F.when(F.col("lang") == "en", "png").alias("image_format"),
    )
    return pages.unionByName(documents)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector components as detections: one label per dimension, its magnitude the confidence."""
    pct = lambda x: F.abs(x.cast("double")) * 400
    vector = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"),
        (F.col("label") * 10).cast("double").alias("min_confidence"),
        F.transform(vector, lambda x, i: F.struct(
            F.concat(F.lit("label"), i.cast("string")).alias("name"), pct(x).alias("confidence"))).alias("labels"),
        F.transform(F.slice(vector, 1, 4), lambda x, i: F.struct(
            F.concat(F.lit("text"), i.cast("string")).alias("text"),
            F.when(x > 0, "LINE").otherwise("WORD").alias("type"))).alias("text"),
        F.transform(F.filter(F.slice(vector, 5, 3), lambda x: x > 0), lambda x: F.struct(
            pct(x).alias("confidence"),
            F.transform(F.slice(vector, 10, 6), lambda e, j: F.struct(
                F.concat(F.lit("emotion"), j.cast("string")).alias("type"), pct(e).alias("confidence"))).alias("emotions"),
        )).alias("faces"),
        F.transform(F.slice(vector, 20, 3), lambda x, i: F.struct(
            F.concat(F.lit("moderation"), i.cast("string")).alias("name"), pct(x).alias("confidence"))).alias("moderation"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records: sign-ups are management events, the rest touch one of four buckets."""
    bucket = F.pmod(F.col("user_id"), F.lit(4))
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "signup", None).when(bucket == 0, "documents")
        .when(bucket == 1, "uploads").when(bucket == 2, "logs").otherwise("other").alias("bucket"),
        F.col("event_type").alias("verb"),
    )

