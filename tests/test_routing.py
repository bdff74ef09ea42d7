"""Routing rules, cascade and classifier parsing."""

import pytest
from pyspark.sql import functions as F

from groundwire.config import FAST_MODEL_ID, REASONING_MODEL_ID, EngineConfig
from groundwire.functions import routing as rules
from groundwire.operators import payloads, routing

SCHEMA = "request_id long, query string, image struct<bucket:string,key:string>, metadata map<string,string>"


def requests(spark, *queries, image=None, metadata=None):
    rows = [(n, q, image, metadata or {}) for n, q in enumerate(queries)]
    return spark.createDataFrame(rows, SCHEMA)


COMPLEXITY = [
    ("hello", "fast", rules.REASON_GREETING),
    ("Thanks!", "fast", rules.REASON_GREETING),
    ("good morning", "fast", rules.REASON_GREETING),
    ("hi there", "fast", rules.REASON_GREETING),
    ("What's up?", "fast", rules.REASON_GREETING),
    ("1 héllo? ", "fast", rules.REASON_SHORT),
    ("123 hello 456", "fast", rules.REASON_GREETING),
    ("history of rome", "fast", rules.REASON_GREETING),
    ("your name", "fast", rules.REASON_GREETING),
    ("What is the PPE policy?", "fast", rules.REASON_FAQ),
    ("Please tell me what is expected in zone A", "fast", rules.REASON_FAQ),
    ("Write a Python function to parse the PPE policy markdown and unit test it.", "reasoning", rules.REASON_CODE),
    ("select a color", "reasoning", rules.REASON_CODE),
    ("IMPORT the list", "reasoning", rules.REASON_CODE),
    ("ımport the list", "reasoning", rules.REASON_CODE),
    ("claſs of 1999", "reasoning", rules.REASON_CODE),
    ("Compare Zone A and Zone B PPE, analyze gaps, and plan a rollout.", "reasoning", rules.REASON_HINT),
    ("hello, compare these", "reasoning", rules.REASON_HINT),
    ("excited", "reasoning", rules.REASON_HINT),
    ("really? sure?", "reasoning", rules.REASON_LONG),
    ("x" * 481, "reasoning", rules.REASON_LONG),
    ("x" * 480, "fast", rules.REASON_SHORT),
    ("a b " * 40 + "c", "reasoning", rules.REASON_LONG),
    ("    \n", "fast", rules.REASON_SHORT),
    ("one two three four five six seven eight", "fast", rules.REASON_SHORT),
    ("one two three four five six seven eight nine", "reasoning", rules.REASON_AMBIGUOUS),
    ("one two three four five six seven eight nine", "reasoning", rules.REASON_AMBIGUOUS),
]


def test_complexity_rules(spark):
    df = routing.classify_complexity(requests(spark, *[c[0] for c in COMPLEXITY]))
    got = [(r.query, r.heuristic.tier, r.heuristic.reason) for r in df.orderBy("request_id").collect()]
    assert got == COMPLEXITY


def test_image_rule_comes_first(spark):
    df = routing.classify_complexity(requests(spark, "hello", image=("uploads", "helmet.png")))
    verdict = df.first().heuristic
    assert (verdict.tier, verdict.confidence) == ("reasoning", 0.97) and "multimodal" in verdict.reason


def test_modality(spark):
    text = routing.route_modality(requests(spark, "Summarize the onboarding handbook")).first()
    assert (text.modality, text.suggest_retrieval, text.use_vision_model) == ("text", True, False)
    both = routing.route_modality(requests(spark, "Is this helmet compliant with policy?", image=("b", "k"))).first()
    assert (both.modality, both.suggest_vision_tool, both.suggest_retrieval) == ("multimodal", True, True)
    only = routing.route_modality(requests(spark, " ", "look", "in an hour please", image=("b", "k"))).orderBy("request_id")
    assert [(r.modality, r.suggest_retrieval) for r in only.collect()] == [
        ("image", False), ("multimodal", False), ("multimodal", True)
    ]


def test_override_and_modes(spark):
    over = requests(spark, "hello", metadata={"model_tier": " Reasoning\n"})
    for mode in ("heuristic", "hybrid", "fast_only"):
        decided = routing.decide_tier(over, EngineConfig(router_mode=mode)).first().decision
        assert (decided.tier, decided.source, decided.confidence) == ("reasoning", "override", 1.0)
    ignored = requests(spark, "hello", metadata={"model_tier": "medium"})
    assert routing.decide_tier(ignored).first().decision.source == "heuristic"
    forced = routing.decide_tier(requests(spark, "hello"), EngineConfig(router_mode="reasoning_only")).first().decision
    assert (forced.tier, forced.source, forced.reason) == ("reasoning", "forced", "ROUTER_MODE=reasoning_only")


RAW = [
    ('{"tier":"fast","confidence":0.81,"reason":"simple ask"}', ("fast", "llm:simple ask", 0.81), None),
    ('```json\n{"tier":"fast","confidence":0.5}\n```', ("fast", "llm:llm classifier", 0.5), None),
    ('``` {"tier":"FAST"} ```', ("fast", "llm:llm classifier", 0.7), None),
    ('Sure: {"tier":"reasoning","confidence":0,"reason":""} ok', ("reasoning", "llm:llm classifier", 0.7), None),
    ('{"tier":"reasoning","confidence":"0.9"}', ("reasoning", "llm:llm classifier", 0.9), None),
    ('{"tier":"reasoning","confidence":3}', ("reasoning", "llm:llm classifier", 3.0), None),
    ('{"tier":"reasoning","confidence":null}', ("reasoning", "llm:llm classifier", 0.7), None),
    ('{"tier":"medium"}', None, "unknown tier"),
    ('{"confidence":1}', None, "unknown tier"),
    ('[{"tier":"fast"}]', None, "not an object"),
    ('{"tier":"fast","confidence":"high"}', None, "confidence is no number"),
    ('{"tier":"fast"} and {"tier":"fast"}', None, "no JSON"),
    ("no json here", None, "no JSON"),
    ("", None, "no JSON"),
]


def test_classifier_parsing(spark):
    df = spark.createDataFrame([(n, r[0]) for n, r in enumerate(RAW)], "request_id long, raw string")
    got = routing.parse_classifier(df).orderBy("request_id").collect()
    for row, (raw, verdict, error) in zip(got, RAW):
        assert row.parse_error == error, raw
        mine = row.verdict and (row.verdict.tier, row.verdict.reason, row.verdict.confidence)
        assert mine == verdict, raw


def test_hybrid_uses_classifier_below_floor(spark):
    asked = requests(spark, "Can you help me with the onboarding notes from last Thursday meeting please", "hello")
    raw = spark.createDataFrame([(0, RAW[0][0]), (1, '{"tier":"reasoning"}')], "request_id long, raw string")
    decided = routing.decide_tier(asked, EngineConfig(), routing.parse_classifier(raw)).orderBy("request_id").collect()
    assert [(r.decision.tier, r.decision.source) for r in decided] == [("fast", "llm"), ("fast", "heuristic")]
    high = EngineConfig(confidence_floor=0.99)
    decided = routing.decide_tier(asked, high, routing.parse_classifier(raw)).orderBy("request_id").collect()
    assert [r.decision.source for r in decided] == ["llm", "llm"]


def test_candidates_are_the_ambiguous_ones(spark):
    long_query = "one two three four five six seven eight nine " + "é" * 400
    rows = routing.classifier_candidates(requests(spark, "hello", long_query)).collect()
    assert [r.request_id for r in rows] == [1]
    assert rows[0].prompt == f"Query: {long_query}\nHas image: False"
    assert routing.classifier_candidates(requests(spark, long_query), EngineConfig(router_mode="heuristic")).count() == 0


def test_model_binding(spark):
    df = routing.bind_models(routing.decide_tier(requests(spark, "hello", "Refactor this CDK stack"))).orderBy("request_id")
    assert [r.model_id for r in df.collect()] == [FAST_MODEL_ID, REASONING_MODEL_ID]
    own = EngineConfig(reasoning_model_override="own-model")
    assert routing.bind_models(routing.decide_tier(requests(spark, "Refactor")), own).first().model_id == "own-model"


@pytest.mark.parametrize("config,model,expected", [
    (EngineConfig(thinking_effort="low"), REASONING_MODEL_ID, (8192, None, "adaptive", "low")),
    (EngineConfig(fast_max_tokens=512), FAST_MODEL_ID, (512, 0.2, None, None)),
    (EngineConfig(thinking_type="disabled", temperature=0.4, max_tokens=1024), f"us.{REASONING_MODEL_ID}",
     (1024, 0.4, "disabled", None)),
])
def test_payload_settings(spark, config, model, expected):
    df = requests(spark, "hi").withColumn("model_id", F.lit(model))
    row = payloads.build_inference_batch(df, config).first()
    assert (row.max_tokens, row.temperature, row.thinking, row.effort) == expected


def test_payload_shape(spark, tmp_path):
    import json

    df = requests(spark, "look", image=("uploads", "a.png")).withColumn("model_id", F.lit(REASONING_MODEL_ID))
    batch = payloads.build_inference_batch(df, EngineConfig(policy_id="p1"))
    payloads.write_inference_batch(batch, str(tmp_path / "batch"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "batch")).collect()]
    body = json.loads(line)
    image, text = body["messages"][0]["content"]
    assert image["image"]["source"] == {"bucket": "uploads", "key": "a.png"}
    assert text["text"].startswith("look\n\nAn image is attached.")
    assert body["inferenceConfig"] == {"maxTokens": 8192}
    assert body["additionalModelRequestFields"] == {"thinking": {"type": "adaptive"}, "output_config": {"effort": "medium"}}
    assert body["guardrailConfig"] == {"guardrailIdentifier": "p1", "guardrailVersion": "DRAFT", "trace": "enabled"}
    assert [t["toolSpec"]["name"] for t in body["toolConfig"]["tools"]] == ["analyze_image", "retrieve_knowledge"]
    plain = payloads.build_inference_batch(requests(spark, "hi").withColumn("model_id", F.lit(FAST_MODEL_ID)), tools=())
    body = json.loads(plain.first().payload)
    assert "toolConfig" not in body and "additionalModelRequestFields" not in body and "guardrailConfig" not in body


def test_model_hook_builds_one_client_per_partition(spark):
    df = spark.range(0, 40, 1, 4).repartition(4)

    def make_client():
        import pyarrow as pa
        import uuid

        mine = uuid.uuid4().hex
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([mine] * batch.num_rows)], names=["id", "client"])

    out = payloads.apply_model(df, make_client, "id long, client string", parallel_calls=2)
    assert out.count() == 40 and out.select("client").distinct().count() <= 2
