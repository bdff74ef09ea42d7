"""Requests, routing and inference batches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from groundwire.config import EngineConfig
from groundwire.operators import payloads, routing
from groundwire.operators.model_stage import run_model
from groundwire.plans import oracle_views as v
from groundwire.plans.registry import register
from groundwire.plans.workspace import new_folder
from groundwire.sources import adapters, requests as request_source

CONFIG = EngineConfig()
_FAST, _REASONING = v.lit(CONFIG.fast_model_id), v.lit(CONFIG.reasoning_model_id)


_CHECKED = f"""WITH {v.REQUESTS},
  bodies AS (
    SELECT 'request-' || request_id AS request_key, query, NULL AS image_format, false AS bad_meta, false AS two_images FROM requests
    UNION ALL SELECT 'document-' || doc_id, text, lang, lang = 'es', lang = 'fr' FROM documents),
  checked AS (SELECT request_key, query, length(query) AS n, list_filter([
      CASE WHEN length(query) > 8000 THEN 'query: too long' END,
      CASE WHEN length(query) < 1 THEN 'query: too short' END,
      CASE WHEN image_format IS NOT NULL THEN 'image_format: not allowed' END,
      CASE WHEN bad_meta THEN 'metadata: value not a string' END], lambda r: r IS NOT NULL) AS problems, two_images FROM bodies)""".replace(
    "NULL AS image_format", "CAST(NULL AS VARCHAR) AS image_format").replace(
    "lang, lang = 'es'", "CASE WHEN lang NOT IN ('fr', 'en') THEN lang END, lang = 'es'")
_REASONS = """CASE WHEN len(problems) = 0 AND two_images THEN 'more than one image source'
  ELSE array_to_string(problems, '; ') END"""


def request_bodies(spark, sf_dir):
    """Requests and whole documents as JSON bodies, most of the latter breaking some rule; English ones give
    their query twice, and the second one counts."""
    asked = adapters.requests(spark, sf_dir).select(
        F.concat(F.lit("request-"), F.col("request_id").cast("string")).alias("request_key"),
        F.to_json(F.struct("query", "session_id", "image", "metadata")).alias("body"),
    )
    lang = F.col("lang")
    shared = [
        F.col("text").alias("query"),
        F.when(~lang.isin("fr", "en"), lang).alias("image_format"),
        F.when(lang == "fr", "https://example.com/a.png").alias("image_url"),
        F.when(lang == "fr", "aGVsbG8=").alias("image_base64"),
    ]
    numbers = F.create_map(F.lit("n"), F.col("n_chars")).alias("metadata")
    texts = F.create_map(F.lit("source"), F.col("source")).alias("metadata")
    documents = adapters.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("request_key"),
        F.when(lang == "es", F.to_json(F.struct(*shared, numbers)))
        .otherwise(F.to_json(F.struct(*shared, texts))).alias("body"), "lang",
    )
    twice = F.concat(F.lit('{"query":"overwritten",'), F.substring("body", F.lit(2), F.length("body")))
    documents = documents.withColumn("body", F.when(lang == "en", twice).otherwise(F.col("body"))).drop("lang")
    return asked.unionByName(documents)


@register("read_requests", f"{_CHECKED} SELECT request_key, CAST(n AS BIGINT) AS query_chars, {_REASONS} AS reasons FROM checked")
def read_requests(spark, sf_dir):
    parsed = request_source.parse_requests(request_bodies(spark, sf_dir))
    return parsed.select(
        "request_key", F.length("query").cast("bigint").alias("query_chars"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@register("scan_requests", f"""{_CHECKED}
  SELECT sha256(query) AS query_sha256, {_REASONS} AS reasons, {_REASONS} = '' AS valid FROM checked""")
def scan_requests(spark, sf_dir):
    """The same bodies as JSON-lines files, scanned as request files are; both results in one."""
    path = new_folder(spark, "request-files")
    request_bodies(spark, sf_dir).select("body").write.text(path)
    valid, rejected = request_source.read_requests(spark, path)
    query = F.sha2("query", 256).alias("query_sha256")
    return valid.select(query, F.lit("").alias("reasons"), F.lit(True).alias("valid")).unionByName(
        rejected.select(query, F.array_join("reasons", "; ").alias("reasons"), F.lit(False).alias("valid"))
    )


@register("route_modality", f"""WITH {v.REQUESTS}
  SELECT request_id, CASE WHEN has_image AND {v.strip('query')} <> '' THEN 'multimodal'
      WHEN has_image THEN 'image' ELSE 'text' END AS modality,
    has_image AS use_vision_model, has_image AS suggest_vision_tool,
    NOT has_image OR {v.any_of('contains(lower(query), {})', routing.RETRIEVAL_HINTS)} AS suggest_retrieval
  FROM requests""")
def route_modality(spark, sf_dir):
    return routing.route_modality(adapters.requests(spark, sf_dir)).select(
        "request_id", "modality", "use_vision_model", "suggest_vision_tool", "suggest_retrieval"
    )


@register("classify_complexity", f"""WITH {v.CLASSIFIED}
  SELECT request_id, tier, reason, source, confidence FROM classified""")
def classify_complexity(spark, sf_dir):
    return routing.classify_complexity(adapters.requests(spark, sf_dir)).select("request_id", "heuristic.*")


_DOCUMENT_RULES = v.CLASSIFIED.replace(
    v.REQUESTS,
    "requests AS (SELECT doc_id AS request_id, source AS session_id, doc_id AS conv_id, 0 AS turn, text AS query,"
    " false AS has_image, NULL AS override_tier, NULL AS requested_at FROM documents)",
)


@register("classify_documents", f"""WITH {_DOCUMENT_RULES}
  SELECT request_id, tier, reason, source, confidence FROM classified""")
def classify_documents(spark, sf_dir):
    """The same rules over whole documents, for long and multilingual text."""
    documents = adapters.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("query")
    )
    return routing.classify_complexity(documents).select("request_id", "heuristic.*")


_PARSED = v.REQUESTS + """,
outputs AS (SELECT request_id, turn, CASE (conv_id+turn)%9
    WHEN 0 THEN 'good' WHEN 1 THEN 'good' WHEN 2 THEN 'good' WHEN 3 THEN 'tier' WHEN 4 THEN 'array'
    WHEN 5 THEN 'zero' WHEN 6 THEN 'word' WHEN 7 THEN 'over' ELSE 'none' END AS form FROM requests),
verdicts AS (SELECT request_id,
  CASE WHEN form = 'good' THEN 'fast' WHEN form IN ('zero', 'over') THEN 'reasoning' END AS tier,
  CASE form WHEN 'good' THEN 'llm:simple ask' WHEN 'zero' THEN 'llm:llm classifier' WHEN 'over' THEN 'llm:turn ' || turn END AS reason,
  CAST(CASE form WHEN 'good' THEN 0.81 WHEN 'zero' THEN 0.7 WHEN 'over' THEN 1.5 END AS DOUBLE) AS confidence,
  CASE form WHEN 'tier' THEN 'unknown tier' WHEN 'array' THEN 'not an object' WHEN 'word' THEN 'confidence is no number'
    WHEN 'none' THEN 'no JSON' END AS parse_error FROM outputs)"""


@register("parse_classifier", f"WITH {_PARSED} SELECT request_id, tier, reason, confidence, parse_error FROM verdicts")
def parse_classifier(spark, sf_dir):
    parsed = routing.parse_classifier(adapters.classifier_outputs(spark, sf_dir))
    return parsed.select(
        "request_id", F.col("verdict.tier").alias("tier"), F.col("verdict.reason").alias("reason"),
        F.col("verdict.confidence").alias("confidence"), "parse_error",
    )


_DECIDED = v.CLASSIFIED + "," + _PARSED.replace(v.REQUESTS + ",", "") + """,
decided AS (SELECT c.request_id, c.query, c.has_image, c.session_id,
  CASE WHEN override_tier IS NOT NULL THEN override_tier WHEN c.confidence >= 0.62 THEN c.tier ELSE coalesce(d.tier, c.tier) END AS tier,
  CASE WHEN override_tier IS NOT NULL THEN 'client metadata override' WHEN c.confidence >= 0.62 THEN c.reason
    ELSE coalesce(d.reason, c.reason) END AS reason,
  CASE WHEN override_tier IS NOT NULL THEN 'override' WHEN c.confidence < 0.62 AND d.tier IS NOT NULL THEN 'llm' ELSE 'heuristic' END AS source,
  CASE WHEN override_tier IS NOT NULL THEN 1.0 WHEN c.confidence >= 0.62 THEN c.confidence
    ELSE coalesce(d.confidence, c.confidence) END AS confidence
  FROM classified c LEFT JOIN verdicts d USING (request_id))"""


def decided(spark, sf_dir):
    verdicts = routing.parse_classifier(adapters.classifier_outputs(spark, sf_dir))
    return routing.decide_tier(adapters.requests(spark, sf_dir), CONFIG, verdicts)


@register("decide_tier", f"WITH {_DECIDED} SELECT request_id, tier, reason, source, confidence FROM decided")
def decide_tier(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", "decision.*")


@register("classifier_candidates", f"""WITH {v.CLASSIFIED}
  SELECT request_id, {_FAST} AS model_id, 'Query: ' || substr(query, 1, 1500) || chr(10) || 'Has image: ' ||
    CASE WHEN has_image THEN 'True' ELSE 'False' END AS prompt
  FROM classified WHERE override_tier IS NULL AND confidence < 0.62""")
def classifier_candidates(spark, sf_dir):
    return routing.classifier_candidates(adapters.requests(spark, sf_dir), CONFIG)


_PROMPT = v.lit(payloads.CLASSIFIER_PROMPT)


@register("classifier_batch", f"""WITH {v.CLASSIFIED}
  SELECT request_id, {_FAST} AS model_id, {_PROMPT} AS system, 'Query: ' || substr(query, 1, 1500) || chr(10) || 'Has image: ' ||
    CASE WHEN has_image THEN 'True' ELSE 'False' END AS user_text, CAST(80 AS BIGINT) AS max_tokens, CAST(0 AS DOUBLE) AS temperature
  FROM classified WHERE override_tier IS NULL AND confidence < 0.62""")
def classifier_batch(spark, sf_dir):
    batch = payloads.classifier_batch(routing.classifier_candidates(adapters.requests(spark, sf_dir), CONFIG))
    field = lambda path: F.get_json_object("payload", path)
    return batch.select(
        "request_id", field("$.modelId").alias("model_id"), field("$.system[0].text").alias("system"),
        field("$.messages[0].content[0].text").alias("user_text"),
        field("$.inferenceConfig.maxTokens").cast("bigint").alias("max_tokens"),
        field("$.inferenceConfig.temperature").cast("double").alias("temperature"),
    )


@register("bind_models", f"""WITH {_DECIDED}
  SELECT request_id, tier, CASE tier WHEN 'fast' THEN {_FAST} ELSE {_REASONING} END AS model_id FROM decided""")
def bind_models(spark, sf_dir):
    return routing.bind_models(decided(spark, sf_dir), CONFIG).select("request_id", "decision.tier", "model_id")


@register("build_inference_batch", f"""WITH {_DECIDED}
  SELECT request_id, CASE tier WHEN 'fast' THEN {_FAST} ELSE {_REASONING} END AS model_id,
    query || CASE WHEN has_image THEN {v.lit(payloads.VISION_HINT)} ELSE '' END AS user_text,
    CAST(CASE WHEN has_image THEN 2 ELSE 1 END AS BIGINT) AS n_blocks,
    CAST(CASE tier WHEN 'fast' THEN 1024 ELSE 8192 END AS BIGINT) AS max_tokens,
    CASE tier WHEN 'fast' THEN CAST(0.2 AS DOUBLE) END AS temperature,
    CASE tier WHEN 'fast' THEN NULL ELSE 'adaptive' END AS thinking,
    CASE tier WHEN 'fast' THEN NULL ELSE 'medium' END AS effort,
    query || CASE WHEN has_image THEN {v.lit(payloads.VISION_HINT)} ELSE '' END AS payload_text,
    CASE WHEN has_image THEN CASE (request_id // 1000) % 2 WHEN 0 THEN 'png' ELSE 'jpeg' END END AS image_format,
    {v.lit(payloads.DEFAULT_SYSTEM_PROMPT)} AS system_text, {v.lit(payloads.DEFAULT_TOOLS[0]["name"])} AS first_tool,
    CASE tier WHEN 'fast' THEN '1024' ELSE '8192' END AS payload_tokens,
    CASE tier WHEN 'fast' THEN NULL ELSE 'adaptive/medium' END AS payload_thinking, 'policy-1/DRAFT/enabled' AS policy
  FROM decided""")
def build_inference_batch(spark, sf_dir):
    """Payloads with their members read back; images of even conversations are known to be PNG."""
    bound = routing.bind_models(decided(spark, sf_dir), CONFIG)
    images = bound.filter(F.col("image").isNotNull() & (F.col("conv_id") % 2 == 0)).select(
        "image.bucket", "image.key", F.lit("png").alias("format")
    ).distinct()
    batch = payloads.build_inference_batch(
        payloads.with_stored_format(bound, images), EngineConfig(policy_id="policy-1")
    )

    def member(*paths):
        return F.concat_ws("/", *[F.get_json_object("payload", f"$.{p}") for p in paths])

    thinking = "additionalModelRequestFields"
    guard = [f"guardrailConfig.{m}" for m in ("guardrailIdentifier", "guardrailVersion", "trace")]
    batch = batch.withColumns({
        "image_format": F.get_json_object("payload", "$.messages[0].content[0].image.format"),
        "system_text": member("system[0].text"), "first_tool": member("toolConfig.tools[0].toolSpec.name"),
        "payload_tokens": member("inferenceConfig.maxTokens"), "policy": member(*guard),
        "payload_thinking": F.nullif(member(f"{thinking}.thinking.type", f"{thinking}.output_config.effort"), F.lit("")),
    })
    # The text as it stands in the payload shows that escaping and block order hold.
    texts = [F.get_json_object("payload", f"$.messages[0].content[{n}].text") for n in (0, 1)]
    return batch.withColumn(
        "payload_text", F.when(F.col("n_blocks") == 1, texts[0]).otherwise(texts[1])
    ).drop("payload")


@register("tier_share", f"""WITH {_DECIDED}
  SELECT tier, source, reason, count(*) AS requests, count(*) / (SELECT count(*) FROM decided) AS share,
    CASE WHEN grouping(tier) = 0 AND grouping(source) = 1 AND grouping(reason) = 1 THEN count(*) / (SELECT count(*) FROM decided)
      - CASE tier WHEN 'fast' THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END END AS over_target
  FROM decided GROUP BY CUBE (tier, source, reason)""")
def tier_share(spark, sf_dir):
    return routing.tier_share(decided(spark, sf_dir))


def rule_bound_client(outage):
    """A client that SQL can repeat: what it says, and how often it is late, follow from the length of the question.
    While the service is out, every fifth length is never answered."""
    def make():
        tries = {}

        def call(payload):
            content = json.loads(payload)["messages"][0]["content"]
            n = len(content[-1]["text"])
            tries[payload] = tries.get(payload, 0) + 1
            if n % 11 == 0:
                raise ValueError("refused")
            if outage and n % 5 == 0:
                raise ConnectionError("service is out")
            if tries[payload] <= n % 3:
                raise TimeoutError("late")
            tier = "fast" if n % 2 == 0 else "reasoning"
            return json.dumps({"tier": tier, "confidence": (n % 5 + 5) / 10, "reason": f"length {n}"})

        return call

    return make


def answered(batch, path):
    """Two runs over one ledger: the second calls only what the outage of the first left open."""
    settings = {"first_wait": 0.0, "note_every": 64}
    run_model(batch, path, rule_bound_client(outage=True), **settings)
    return run_model(batch, path, rule_bound_client(outage=False), **settings)


# Outcome of a call whose question has n characters.
_OUTCOME = """CASE WHEN n % 11 <> 0 THEN CASE n % 2 WHEN 0 THEN 'fast' ELSE 'reasoning' END END AS said,
    CASE WHEN n % 11 <> 0 THEN CAST((n % 5 + 5) / 10.0 AS DOUBLE) END AS sure,
    CASE n % 11 WHEN 0 THEN 'ValueError: refused' END AS error, CASE n % 11 WHEN 0 THEN 1 ELSE n % 3 + 1 END AS attempts"""


@register("model_results", f"""WITH {_DECIDED},
  asked AS (SELECT request_id, length(query || CASE WHEN has_image THEN {v.lit(payloads.VISION_HINT)} ELSE '' END) AS n FROM decided),
  outcomes AS (SELECT request_id, n, {_OUTCOME} FROM asked)
  SELECT request_id, CASE WHEN said IS NOT NULL THEN 'length ' || n END AS answer, error, false AS passing, CAST(attempts AS BIGINT) AS attempts
  FROM outcomes""")
def model_results(spark, sf_dir):
    """Every request's payload through the model, over two runs."""
    bound = routing.bind_models(decided(spark, sf_dir), CONFIG)
    results = answered(payloads.build_inference_batch(bound, CONFIG), new_folder(spark, "model-results"))
    return results.select(
        "request_id", F.get_json_object("output", "$.reason").alias("answer"), "error", "passing",
        F.col("attempts").cast("bigint").alias("attempts"),
    )


@register("classify_by_model", f"""WITH {v.CLASSIFIED},
  open AS (SELECT *, length('Query: ' || substr(query, 1, 1500) || chr(10) || 'Has image: ' || CASE WHEN has_image THEN 'True' ELSE 'False' END) AS n
    FROM classified),
  outcomes AS (SELECT *, {_OUTCOME}, override_tier IS NULL AND confidence < 0.62 AS by_model FROM open),
  settled AS (SELECT *, by_model AND said IS NOT NULL AS heard FROM outcomes)
  SELECT request_id, CASE WHEN override_tier IS NOT NULL THEN override_tier WHEN heard THEN said ELSE tier END AS tier,
    CASE WHEN override_tier IS NOT NULL THEN 'client metadata override' WHEN heard THEN 'llm:length ' || n ELSE reason END AS reason,
    CASE WHEN override_tier IS NOT NULL THEN 'override' WHEN heard THEN 'llm' ELSE 'heuristic' END AS source,
    CASE WHEN override_tier IS NOT NULL THEN 1.0 WHEN heard THEN sure ELSE confidence END AS confidence,
    CASE WHEN by_model THEN error END AS error, CAST(CASE WHEN by_model THEN attempts END AS BIGINT) AS attempts FROM settled""")
def classify_by_model(spark, sf_dir):
    """Requests the rules leave open go to the classifier; one that it refuses keeps the rule's decision."""
    asked = adapters.requests(spark, sf_dir)
    batch = payloads.classifier_batch(routing.classifier_candidates(asked, CONFIG))
    outputs = answered(batch.select("request_id", "payload"), new_folder(spark, "classified"))
    verdicts = routing.parse_classifier(outputs.withColumnRenamed("output", "raw"))
    calls = outputs.select("request_id", "error", F.col("attempts").cast("bigint").alias("attempts"))
    return routing.decide_tier(asked, CONFIG, verdicts).join(calls, "request_id", "left").select(
        "request_id", "decision.*", "error", "attempts"
    )
