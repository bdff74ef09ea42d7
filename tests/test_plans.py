"""Physical plans and the helpers that keep tasks balanced."""

import pytest
from pyspark.sql import functions as F

from groundwire.functions.text import compute_once, strip, word_count, words
from groundwire.operators import operations, routing
from groundwire.plans.catalog import QUERIES
from groundwire.plans.skew import salted_join
from groundwire.sources import adapters
from groundwire.sources.chunk_store import latest_chunks

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "LocalLimit", "GlobalLimit")
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_row_udfs_or_limits(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not [node for node in FORBIDDEN if node in plan]


def test_routing_needs_no_shuffle_and_reads_what_it_uses(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    routed = routing.bind_models(routing.decide_tier(routing.route_modality(adapters.requests_of(turns))))
    plan = plan_of(routed.select("request_id", "decision", "model_id"))
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan


def test_filters_do_not_repeat_expensive_columns(spark):
    df = spark.createDataFrame([(1, "a B")], "n int, text string")
    once = compute_once(df, {"low": F.lower("text")}).filter((F.col("low") != "x") & F.col("low").contains("b"))
    assert plan_of(once).count("lower(") == 1


def test_rank_limits_are_pushed_below_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "chunk_id string, version int")
    assert plan_of(latest_chunks(df, "version")).count("WindowGroupLimit") == 2


def test_dashboard_reads_few_columns(spark):
    from groundwire.sources.access_log import with_routes

    plan = plan_of(operations.dashboard_rollup(with_routes(adapters.access_log(spark, SF_DIR))))
    assert "props" not in plan and "user_id" not in plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(1000).select((F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9)).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (77, "w")], "k long, w string")
    salted = salted_join(left, right, ["k"], [F.col("v")], how=how, salts=5).select("k", "v", "w")
    plain = left.join(right, ["k"], how).select("k", "v", "w")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_unicode_whitespace(spark):
    text = "　  a b\x1cc \n"
    row = spark.createDataFrame([(text,), (" ",), ("",)], "t string").select(
        strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n"), words(F.col("t")).alias("w")).collect()
    assert [(r.s, r.n, r.w) for r in row] == [(text.strip(), 3, text.split()), ("", 0, []), ("", 0, [])]
