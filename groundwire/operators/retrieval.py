"""Knowledge retrieval: questions to cited passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwire.config import EXCERPT_CHARS
from groundwire.functions.text import blank_to_null, strip
from groundwire.operators.ingestion import embed_chunks
from groundwire.operators.knowledge_index import open_index
from groundwire.operators.payloads import RETRIEVAL_TOOL
from groundwire.operators.tool_loop import STOP_TOOL, run_citations
from groundwire.operators.vectors import CellIndex, vector_topk
from groundwire.plans.skew import spread_join
from groundwire.plans.workspace import materialize
from groundwire.sources.chunk_store import read_chunks

# Fixed value: source named when a hit has neither a URI nor a location type.
UNKNOWN_SOURCE = "knowledge-base"


def shape_citations(hits: DataFrame) -> DataFrame:
    """Citation rows from hits (uri, location_type, score, content); duplicates are kept."""
    others = [c for c in hits.columns if c not in ("uri", "location_type", "content")]
    source = F.coalesce(
        blank_to_null(F.col("uri")), blank_to_null(F.col("location_type")), F.lit(UNKNOWN_SOURCE)
    )
    excerpt = F.substring(F.coalesce("content", F.lit("")), 1, EXCERPT_CHARS)
    return hits.select(*others, source.alias("source"), excerpt.alias("excerpt"))


def retrieve_from_store(
    requests: DataFrame, path: str, embedder: PipelineModel | Callable[[DataFrame], DataFrame], k: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """``retrieve_knowledge`` over the store below ``path`` through its search index. Fails for a store that has
    none; what was stored after the last refresh is not found yet."""
    spark = requests.sparkSession
    index = open_index(spark, path)
    if index is None:
        raise ValueError(f"{path} has no search index: refresh_index creates it")
    return retrieve_knowledge(requests, read_chunks(spark, path), embedder, k, index=index)


def retrieve_knowledge(
    requests: DataFrame, chunks: DataFrame,
    embedder: PipelineModel | Callable[[DataFrame], DataFrame], k: int = 5, *, index: CellIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(citations, rejected): nearest passages per request; blank queries are rejected.

    ``requests``: request_id, query, optional requested. ``chunks``: chunk_id, uri, text, and embedding unless an
    ``index`` of them is given. Texts are joined to the few hits after the search, never carried through it.
    """
    blank = F.coalesce(strip(F.col("query")) == "", F.lit(True))
    rejected = requests.filter(blank).select("request_id", F.lit("retrieve_knowledge requires a query").alias("error"))
    asked = requests.filter(~blank).withColumnRenamed("request_id", "query_id")
    keep = ["query_id"] + (["requested"] if "requested" in asked.columns else [])
    embedded = embed_chunks(asked.select(*keep, strip(F.col("query")).alias("text")), embedder)
    # Read twice below; a few ids per request, so cheap to write.
    hits = materialize(vector_topk(embedded, index or chunks, k), "hits")
    cited = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "chunk_id", "uri", F.substring("text", 1, EXCERPT_CHARS).alias("content"), F.lit("S3").alias("location_type"),
        F.create_map(F.lit("type"), F.lit("S3"), F.lit("uri"), F.col("uri")).alias("location"),
    )
    # One passage may answer very many requests; only such passages are repeated.
    scored = spread_join(hits, cited, ["chunk_id"], [F.col("query_id")], how="inner").withColumn(
        "score", F.round(1.0 / (1.0 + F.col("distance") * F.col("distance")), 6)
    )
    return shape_citations(scored.withColumnRenamed("query_id", "request_id")), rejected


def run_searches(looped: DataFrame, paired: DataFrame, tool: str = RETRIEVAL_TOOL) -> DataFrame:
    """(request_id, i, position, query, requested) of the searches that runs really made.

    ``paired``: the tool calls of turns with their input and status. A discarded turn makes no call, and a call that
    failed cites nothing. An input that is no JSON, or names no query, gives a null query.
    """
    executed = looped.filter((F.col("stop_reason") == STOP_TOOL) & ~F.col("discarded")).select("request_id", "i").distinct()
    made = paired.filter((F.col("tool") == tool) & (F.col("status") == "success"))
    return made.join(executed, ["request_id", "i"], "left_semi").select(
        "request_id", "i", "position", F.get_json_object("input", "$.query").alias("query"),
        F.get_json_object("input", "$.number_of_results").try_cast("int").alias("requested"),
    )


def cite_searches(
    searches: DataFrame, path: str, embedder: PipelineModel | Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Citations of runs, in the order of their searches, from the index of the store below ``path``.

    Equal questions are searched once. One question may stand for a third of all searches: it is one row per task
    before the shuffle, and its few hits are repeated for the buckets of its searches. A search without a question cites nothing.
    """
    asked = searches.withColumn("query", strip(F.col("query"))).filter(F.col("query") != "")
    asked = asked.withColumn("question", F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("requested"), F.lit(0)).cast("string"), "query"), 256))
    asked = materialize(asked, "searches")  # read for the questions, for the counts of the join, and by it
    questions = asked.select(F.col("question").alias("request_id"), "query", "requested").dropDuplicates(["request_id"])
    hits, _ = retrieve_from_store(questions, path, embedder)
    cited = spread_join(
        asked.select("question", "request_id", "i", "position"), hits.withColumnRenamed("request_id", "question"),
        ["question"], [F.col("request_id"), F.col("i"), F.col("position")], how="inner",
    )
    return run_citations(cited.drop("question"), ("i", "position", "rank"))
