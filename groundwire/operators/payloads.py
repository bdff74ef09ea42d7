"""Offline inference batches: one request payload per row, and a hook for external models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.config import FAST_TEMPERATURE, THINKING_MODEL_FRAGMENT, EngineConfig
from groundwire.sources.images import decode_inline, image_format
from groundwire.sources.requests import has_image

# Fixed value: text added to the question when an image is attached.
VISION_HINT = (
    "\n\nAn image is attached. Call analyze_image if structured vision "
    "signals would improve the answer, then retrieve_knowledge if documents apply."
)
# Tool names and their input fields.
VISION_TOOL = "analyze_image"
RETRIEVAL_TOOL = "retrieve_knowledge"
DEFAULT_TOOLS: tuple[Mapping, ...] = (
    {
        "name": VISION_TOOL,
        "description": "Labels, text lines, faces and moderation signals of an image.",
        "input": {"bucket": "string", "key": "string", "min_confidence": "number"},
        "required": [],
    },
    {
        "name": RETRIEVAL_TOOL,
        "description": "Passages of the ingested documents closest to a query, with source URIs.",
        "input": {"query": "string", "number_of_results": "integer"},
        "required": ["query"],
    },
)
DEFAULT_SYSTEM_PROMPT = (
    "Answer from retrieved passages and attached images. List the URIs of the passages used under "
    "Sources, never invent one, and say so when nothing relevant was found."
)

CLASSIFIER_PROMPT = (
    'Decide which model tier a request needs. Answer with JSON only: {"tier": "fast" or "reasoning", '
    '"confidence": 0.0 to 1.0, "reason": a few words}. Small talk and single facts are fast; code, images, '
    "planning and questions over several documents need reasoning."
)
# Limits of a classifier call.
CLASSIFIER_MAX_TOKENS = 80
CLASSIFIER_TEMPERATURE = 0


def tool_specs(tools: Sequence[Mapping]) -> list[dict]:
    return [
        {
            "toolSpec": {
                "name": tool["name"],
                "description": tool["description"],
                "inputSchema": {"json": {
                    "type": "object",
                    "properties": {k: {"type": v} for k, v in tool["input"].items()},
                    "required": list(tool["required"]),
                }},
            }
        }
        for tool in tools
    ]


def _thinks(model_id: Column) -> Column:
    return model_id.contains(THINKING_MODEL_FRAGMENT)


def inference_settings(model_id: Column, config: EngineConfig) -> dict[str, Column]:
    """Token limit, temperature and thinking mode by model; null means the field is left out."""
    thinks = _thinks(model_id)
    adaptive = config.thinking_type == "adaptive"
    own_temperature = F.lit(None).cast("double") if adaptive else F.lit(float(config.temperature))
    return {
        "max_tokens": F.when(thinks, config.max_tokens).otherwise(config.fast_max_tokens).cast("bigint"),
        "temperature": F.when(thinks, own_temperature).otherwise(F.lit(FAST_TEMPERATURE)),
        "thinking": F.when(thinks, config.thinking_type),
        "effort": F.when(thinks & F.lit(adaptive), config.thinking_effort),
    }


def build_inference_batch(
    requests: DataFrame, config: EngineConfig = EngineConfig(), *,
    tools: Sequence[Mapping] = DEFAULT_TOOLS, system_prompt: str = DEFAULT_SYSTEM_PROMPT,
) -> DataFrame:
    """(request_id, query, image…, model_id) rows to payload rows, ready for a JSON-lines sink."""
    image = has_image(requests)
    text = F.concat(F.col("query"), F.when(image, VISION_HINT).otherwise(""))
    # Absent members stay null and to_json leaves them out.
    image_block = F.struct(_image_source(requests).alias("image"), _null_text().alias("text"))
    text_block = F.struct(F.lit(None).cast(_IMAGE_TYPE).alias("image"), text.alias("text"))
    content = F.when(image, F.array(image_block, text_block)).otherwise(F.array(text_block))
    settings = inference_settings(F.col("model_id"), config)
    prepared = requests.select(
        "request_id", "model_id", text.alias("user_text"), content.alias("_content"),
        *[c.alias(k) for k, c in settings.items()],
    )
    thinking = F.when(F.col("thinking").isNotNull(), F.struct(
        F.struct(F.col("thinking").alias("type")).alias("thinking"),
        F.when(F.col("effort").isNotNull(), F.struct("effort")).alias("output_config"),
    ))
    fields = [
        F.col("model_id").alias("modelId"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("_content").alias("content"))).alias("messages"),
        F.array(F.struct(F.lit(system_prompt).alias("text"))).alias("system"),
        F.struct(
            F.col("max_tokens").alias("maxTokens"), F.col("temperature").alias("temperature")
        ).alias("inferenceConfig"),
        thinking.alias("additionalModelRequestFields"),
    ]
    if tools:
        spec = {"tools": tool_specs(tools), "toolChoice": {"auto": {}}}
        fields.append(F.parse_json(F.lit(json.dumps(spec))).alias("toolConfig"))
    if config.policy_id:
        fields.append(F.struct(
            F.lit(config.policy_id).alias("guardrailIdentifier"),
            F.lit(config.policy_version).alias("guardrailVersion"),
            F.lit("enabled").alias("trace"),
        ).alias("guardrailConfig"))
    return prepared.select(
        "request_id", "model_id", "user_text", F.size("_content").cast("bigint").alias("n_blocks"),
        *settings, F.to_json(F.struct(*fields)).alias("payload"),
    )


def classifier_batch(candidates: DataFrame, system_prompt: str = CLASSIFIER_PROMPT) -> DataFrame:
    """(request_id, model_id, prompt) to short, deterministic classification payloads."""
    text = lambda c: F.array(F.struct(c.alias("text")))
    payload = F.struct(
        F.col("model_id").alias("modelId"),
        F.array(F.struct(F.lit("user").alias("role"), text(F.col("prompt")).alias("content"))).alias("messages"),
        text(F.lit(system_prompt)).alias("system"),
        F.struct(
            F.lit(CLASSIFIER_MAX_TOKENS).alias("maxTokens"), F.lit(CLASSIFIER_TEMPERATURE).alias("temperature")
        ).alias("inferenceConfig"),
    )
    return candidates.select("request_id", "model_id", F.to_json(payload).alias("payload"))


_IMAGE_TYPE = "struct<format:string,source:struct<bucket:string,key:string,url:string,base64:string>>"


def _null_text() -> Column:
    return F.lit(None).cast("string")


def with_stored_format(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``stored_format`` to requests with a stored image, from resolved images (bucket, key, format)."""
    known = images.select(F.col("bucket").alias("_b"), F.col("key").alias("_k"), F.col("format").alias("stored_format"))
    return requests.join(known, (F.col("image.bucket") == F.col("_b")) & (F.col("image.key") == F.col("_k")), "left").drop("_b", "_k")


def _image_format(requests: DataFrame) -> Column:
    """The rule of the image scan: what was declared, else what the bytes say, else its default."""
    def given(name: str) -> Column:
        return F.col(name) if name in requests.columns else _null_text()

    declared = F.when(given("image_format") != "", given("image_format"))
    return F.coalesce(declared, given("stored_format"), image_format(decode_inline(given("image_base64"))))


def _image_source(requests: DataFrame) -> Column:
    def field(name: str, path: str) -> Column:
        return F.col(path) if name in requests.columns else _null_text()

    return F.struct(
        _image_format(requests).alias("format"),
        F.struct(
            field("image", "image.bucket").alias("bucket"), field("image", "image.key").alias("key"),
            field("image_url", "image_url").alias("url"), field("image_base64", "image_base64").alias("base64"),
        ).alias("source"),
    )


def write_inference_batch(batch: DataFrame, path: str) -> None:
    batch.select(F.col("payload").alias("value")).write.mode("append").text(path)


def apply_model(
    rows: DataFrame, make_client: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Run an external model over Arrow batches; the client is built once per partition.

    Filter to the rows that need the model first: Spark does not move filters across a Python step.
    ``parallel_calls`` caps how many partitions call the service at once; the rows are dealt out for it, so the
    steps before keep their own parallelism.
    """
    limited = rows.repartition(parallel_calls) if parallel_calls else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            yield client(batch)

    return limited.mapInArrow(run, schema)
