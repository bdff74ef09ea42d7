"""Citations of a run from its own searches, and the join that spreads hot keys."""

from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import ingestion, knowledge_index, retrieval, tool_loop as loops
from groundwire.plans.skew import spread_join

PAIRED = "request_id long, i long, position long, tool string, status string, input string"
LOOPED = "request_id long, i long, stop_reason string, discarded boolean"


def store(spark, tmp_path, **texts):
    path = str(tmp_path / "store")
    rows = [(f"s3://docs/{name}", "knowledge/", text, 1) for name, text in texts.items()]
    ingestion.ingest_knowledge(spark.createDataFrame(rows, "uri string, key string, text string, version int"), path, letter_embedder)
    knowledge_index.refresh_index(spark, path)
    return path


def question(text, wanted=None):
    return '{"query":"%s"%s}' % (text, "" if wanted is None else f',"number_of_results":{wanted}')


def test_only_searches_that_were_made_count(spark):
    run = spark.createDataFrame([
        (1, 0, "tool_use", False), (1, 1, "tool_use", True), (1, 2, "tool_use", False), (1, 3, "end_turn", False),
    ], LOOPED)
    paired = spark.createDataFrame([
        (1, 0, 0, "retrieve_knowledge", "success", question("a", 2)),
        (1, 0, 1, "analyze_image", "success", question("b")),
        (1, 1, 0, "retrieve_knowledge", "success", question("discarded")),
        (1, 2, 0, "retrieve_knowledge", "error", question("failed")),
        (1, 2, 1, "retrieve_knowledge", "success", "no json"),
        (1, 2, 2, "retrieve_knowledge", "success", '{"query":"c","number_of_results":"many"}'),
        (2, 0, 0, "retrieve_knowledge", "success", question("no such run")),
    ], PAIRED)
    got = retrieval.run_searches(run, paired).orderBy("i", "position").collect()
    assert [(r.i, r.position, r.query, r.requested) for r in got] == [(0, 0, "a", 2), (2, 1, None, None), (2, 2, "c", None)]


def test_citations_follow_the_searches_of_the_run(spark, tmp_path):
    path = store(spark, tmp_path, apples="aaaa aaaa", bees="bbbb bbbb", seas="cccc cccc")
    searches = spark.createDataFrame([
        (1, 1, 0, " bbbb ", 1), (1, 0, 0, "aaaa", 1), (1, 2, 0, "aaaa", 1),  # a repeated hit is cited again
        (2, 0, 0, "cccc", 0), (3, 0, 0, "  ", 1), (4, 0, 0, None, 1),
    ], "request_id long, i long, position long, query string, requested int")
    cited = {r.request_id: r.citations for r in retrieval.cite_searches(searches, path, letter_embedder).collect()}
    assert [c.source for c in cited[1]] == ["s3://docs/apples", "s3://docs/bees", "s3://docs/apples"]
    assert cited[1][0].excerpt == "aaaa aaaa" and cited[1][0].score == 1.0
    assert cited[1][1].location == {"type": "S3", "uri": "s3://docs/bees"}
    assert len(cited[2]) == 3 and cited[2][0].source == "s3://docs/seas"  # zero asks for the default of five
    assert set(cited) == {1, 2}


def test_final_responses_without_searches_have_no_citations(spark, tmp_path):
    calls = "request_id long, i long, stop_reason string, tools array<string>, answer string, tier string, reason string," \
            " source string, latency_ms long, policy_trace struct<action:string>"
    run = loops.tool_loop(spark.createDataFrame([(9, 0, "end_turn", [], "Done.", "fast", "why", "heuristic", 1, None)], calls))
    searches = retrieval.run_searches(run, spark.createDataFrame([], PAIRED))
    cited = retrieval.cite_searches(searches, store(spark, tmp_path, a="aaaa"), letter_embedder)
    (row,) = loops.finalize_responses(run, citations=cited).collect()
    assert row.citations is None and row.answer == "Done."


def test_spread_join_gives_the_plain_join(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    left = spark.range(6000).select("id", key.alias("k")).withColumn("k", F.when(F.col("id") % 50 == 2, "warm").otherwise(F.col("k")))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), ("1", 4), ("4", 5), (None, 6)], "k string, v int")
    for how in ("left", "inner"):
        plain = sorted(left.join(right, "k", how).select("id", "k", "v").collect(), key=str)
        for bucket_rows in (100, 100_000):
            spread = spread_join(left, right, ["k"], [F.col("id")], how=how, bucket_rows=bucket_rows)
            assert sorted(spread.select("id", "k", "v").collect(), key=str) == plain


def test_spread_join_deals_the_hot_key(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = spread_join(left, right, ["k"], [F.col("id")], bucket_rows=500)
    exchanges = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in exchanges and joined.count() == 4000
