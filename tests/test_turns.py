"""Turns, tool results, grounding and the rebuilt tool loop."""

from pyspark.sql import functions as F

from groundwire.config import EngineConfig
from groundwire.operators import tool_loop as loops, turns

CALLS = ("request_id long, i long, stop_reason string, tools array<string>, answer string, tier string, reason string,"
         " source string, latency_ms long, policy_trace struct<action:string>")


def calls(spark, *runs):
    rows = []
    for request_id, (tier, steps) in enumerate(runs):
        for i, (stop, tools, answer) in enumerate(steps):
            trace = ("BLOCKED" if answer == "x" else None,) if stop == "guardrail_intervened" else None
            rows.append((request_id, i, stop, tools, answer if answer != "x" else None, tier, "why", "heuristic", 10, trace))
    return spark.createDataFrame(rows, CALLS)


TOOL = ("tool_use", ["retrieve_knowledge"], None)
VISION = ("tool_use", ["analyze_image"], None)
TWO = ("tool_use", ["retrieve_knowledge", "retrieve_knowledge"], None)
DONE = ("end_turn", [], "Done.")
DOUBT = ("end_turn", [], "Sorry, I DO NOT KNOW.")
STOP = ("guardrail_intervened", [], None)
RUNS = [
    ("fast", [TOOL, DONE]),                      # 0 plain answer
    ("fast", [VISION, DONE]),                    # 1 vision escalates at once
    ("fast", [TWO, TOOL, DONE]),                 # 2 two calls escalate
    ("fast", [TOOL, TOOL, DONE]),                # 3 second tool turn escalates
    ("fast", [DOUBT, DONE]),                     # 4 doubt escalates
    ("reasoning", [VISION, DOUBT, DONE]),        # 5 reasoning never escalates, stops at the doubt
    ("fast", [STOP]),                            # 6 policy stop wins
    ("fast", [TOOL] * 8),                        # 7 limit, calls past it are dropped
    ("fast", [DONE, TWO]),                       # 8 rows after the stop are dropped
    ("fast", [DOUBT, DOUBT]),                    # 9 after escalation a doubt is an answer
    ("reasoning", [TOOL]),                       # 10 log ends early
    ("fast", [TOOL, ("guardrail_intervened", [], "x")]),  # 11 policy stop after a tool turn
]
EXPECTED = {
    0: (2, None, "answered"), 1: (2, loops.ESCALATE_TOOLS, "answered"), 2: (2 + 1, loops.ESCALATE_TOOLS, "answered"),
    3: (3, loops.ESCALATE_TOOLS, "answered"), 4: (2, loops.ESCALATE_ANSWER, "answered"), 5: (2, None, "answered"),
    6: (1, None, "guardrail"), 7: (6, loops.ESCALATE_TOOLS, "max iterations"), 8: (1, None, "answered"),
    9: (2, loops.ESCALATE_ANSWER, "answered"), 10: (1, None, "incomplete"), 11: (2, None, "guardrail"),
}


def test_tool_loop(spark):
    rows = loops.tool_loop(calls(spark, *RUNS)).collect()
    for request_id, expected in EXPECTED.items():
        mine = sorted((r for r in rows if r.request_id == request_id), key=lambda r: r.i)
        causes = [r.escalation for r in mine if r.escalation]
        assert (len(mine), causes[0] if causes else None, mine[0].stop_cause) == expected, request_id
    third = sorted((r for r in rows if r.request_id == 3), key=lambda r: r.i)
    assert [r.effective_tier for r in third] == ["fast", "fast", "reasoning"]
    assert [r.discarded for r in third] == [False, True, False]


def test_switch_turns_escalation_off(spark):
    rows = loops.tool_loop(calls(spark, *RUNS), EngineConfig(escalate_on_tools=False)).collect()
    assert not any(r.escalation for r in rows)
    assert max(r.i for r in rows if r.request_id == 4) == 0


def test_final_responses(spark):
    final = {r.request_id: r for r in loops.finalize_responses(loops.tool_loop(calls(spark, *RUNS))).collect()}
    assert len(final) == len(RUNS)
    assert (final[0].answer, final[0].model_tier, final[0].router_source) == ("Done.", "fast", "heuristic")
    assert (final[4].answer, final[4].model_tier, final[4].router_source) == ("Done.", "reasoning", "forced")
    assert final[4].router_reason == "escalation:low-confidence fast-tier answer"
    assert final[9].answer == "Sorry, I DO NOT KNOW."
    assert final[6].answer == loops.FALLBACK_POLICY and final[6].policy_action == "intervened"
    assert final[11].policy_action == "BLOCKED" and final[0].policy_action is None
    assert final[7].answer == loops.FALLBACK_LIMIT and final[7].iterations == 6 and final[7].latency_ms == 60


def test_report_and_usage(spark):
    report = loops.escalation_report(loops.tool_loop(calls(spark, *RUNS))).collect()
    assert {(r.cause, r.escalations, r.fast_starts) for r in report} == {
        (loops.ESCALATE_TOOLS, 4, 10), (loops.ESCALATE_ANSWER, 2, 10)}
    big = 2**53 + 1
    used = spark.createDataFrame([
        (1, '{"inputTokens": 10, "outputTokens": 5.9, "kind": "x", "billed": "12"}'), (1, '{"inputTokens": 20, "outputTokens": 40.9}'),
        (2, f'{{"cache": -1.5, "read": {big}, "none": null, "list": [1]}}'),
    ], "request_id long, usage string").withColumn("usage", F.from_json("usage", "map<string,variant>"))
    got = {r.request_id: r.usage for r in loops.usage_maps(loops.accumulate_usage(used)).collect()}
    assert got == {1: {"inputTokens": 30, "outputTokens": 45}, 2: {"cache": -1, "read": big}}


def test_traces_leave_out_discarded_turns(spark):
    looped = loops.tool_loop(calls(spark, ("fast", [TOOL, TOOL, DONE])))
    paired = spark.createDataFrame(
        [(0, i, f"0-{i}", "retrieve_knowledge", "success", "r") for i in range(2)],
        "request_id long, i long, tool_use_id string, tool string, status string, output_preview string")
    (row,) = loops.run_traces(looped, paired).collect()
    assert [t.i for t in row.tool_trace] == [0]


def test_traces_keep_the_order_of_the_calls(spark):
    looped = loops.tool_loop(calls(spark, ("reasoning", [TOOL, DONE])))
    paired = spark.createDataFrame(
        [(0, 0, 1, "a", "analyze_image", '{"n":1}', "success", "r"), (0, 0, 0, "b", "retrieve_knowledge", '{"n":0}', "success", "r")],
        "request_id long, i long, position long, tool_use_id string, tool string, input string, status string, output_preview string")
    hits = spark.createDataFrame([(0, 2, "s3://b"), (0, 1, "s3://a")], "request_id long, rank long, uri string")
    traces = loops.run_traces(looped, paired)
    (row,) = loops.finalize_responses(looped.withColumn("session_id", F.lit("s")), None, traces, loops.run_citations(hits)).collect()
    assert [(t.name, t.input) for t in row.tool_trace] == [("retrieve_knowledge", '{"n":0}'), ("analyze_image", '{"n":1}')]
    assert row.session_id == "s" and [c.uri for c in row.citations] == ["s3://a", "s3://b"]


def test_pairing(spark):
    asked = spark.createDataFrame([(1, 0, "a", "retrieve_knowledge"), (1, 1, "b", "mystery"), (1, 2, "c", "analyze_image")],
                                  "request_id long, i long, tool_use_id string, tool string")
    results = spark.createDataFrame([(1, "a", "x" * 2000), (1, "b", "ignored")], "request_id long, tool_use_id string, result string")
    got = {r.tool_use_id: r for r in turns.pair_tool_results(asked, results).collect()}
    assert (got["a"].status, len(got["a"].output_preview)) == ("success", 1500)
    assert (got["b"].status, got["b"].output_preview) == ("error", '{"error":"Unknown tool: mystery"}')
    assert got["c"].status == "error"
    stats = {r.tool: (r.calls, r.errors) for r in turns.tool_stats(turns.pair_tool_results(asked, results)).collect()}
    assert stats == {"retrieve_knowledge": (1, 0), "mystery": (1, 1), "analyze_image": (1, 1)}


def test_turn_pairs_and_long_sessions(spark):
    rows = [("s", n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(151)]
    df = spark.createDataFrame(rows, "session_id string, turn long, role string, text string")
    pairs = turns.pair_turns(df).orderBy("turn").collect()
    assert len(pairs) == 76 and pairs[0].answer == "t1" and not pairs[-1].answered
    blocks = turns.message_blocks(df, 64).orderBy("block").collect()
    assert [b.n_messages for b in blocks] == [64, 64, 23]
    assert [m.text for b in blocks for m in b.messages] == [f"t{n}" for n in range(151)]
    (whole,) = turns.assemble_messages(df).collect()
    assert whole.n_messages == 151 and [m.text for m in whole.messages] == [f"t{n}" for n in range(151)]


def test_the_answer_may_come_later(spark):
    rows = [("s", 0, "user"), ("s", 1, "system"), ("s", 2, "assistant"), ("s", 3, "user"), ("s", 200, "assistant"), ("s", 201, "user"),
            ("t", 1, "user")]
    df = spark.createDataFrame(rows, "session_id string, turn long, role string").withColumn("text", F.concat("role", F.col("turn").cast("string")))
    got = {(r.session_id, r.turn): r.answer for r in turns.pair_turns(df).collect()}
    assert got == {("s", 0): "assistant2", ("s", 3): "assistant200", ("s", 201): None, ("t", 1): None}


def test_grounding(spark):
    answers = spark.createDataFrame([
        (1, "s", "Hard hats. Sources: s3://docs/ppe.md."), (2, "s", "See s3://docs/other.md and s3://docs/ppe.md"),
        (3, "s", "No idea"), (4, "t", "s3://docs/ppe.md"),
    ], "answer_id long, session_id string, answer string")
    citations = spark.createDataFrame([("s", "s3://docs/ppe.md"), ("s", "s3://docs/ppe.md")], "session_id string, uri string")
    got = {r.answer_id: (r.cited, r.ungrounded, r.verdict) for r in turns.citation_grounding(answers, citations).collect()}
    assert got == {1: (1, 0, "grounded"), 2: (2, 1, "ungrounded"), 3: (0, 0, "no citation"), 4: (1, 1, "ungrounded")}


def test_no_question_is_lost_or_doubled(spark):
    rows = [
        ("s", 1, "user", "a"), ("s", 1, "user", "b"), ("s", 2, "assistant", "y"), ("s", 2, "assistant", "x"), ("s", 2, "user", "c"),
        ("s", None, "user", "d"), (None, 3, "user", "e"), (None, 4, "assistant", "z"), ("s", None, "assistant", "w"), ("s", 2, "user", "c"),
        ("t", 1, "user", "f"), ("t", 1, "assistant", "same number"), ("t", 900, "assistant", None),
    ]
    got = sorted((r.question, r.answer, r.answered) for r in turns.pair_turns(
        spark.createDataFrame(rows, "session_id string, turn long, role string, text string")).collect())
    assert got == [("a", "x", True), ("b", "x", True), ("c", None, False), ("c", None, False), ("d", None, False), ("e", None, False), ("f", None, True)]
