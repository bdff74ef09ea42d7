"""Final responses that cite what their own run retrieved."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import ingestion, knowledge_index, retrieval, tool_loop as loops
from groundwire.plans import oracle_views as v
from groundwire.plans.knowledge_queries import letters_sql, versioned
from groundwire.plans.registry import register
from groundwire.plans.turn_queries import CONFIG, FINAL, looped, paired_of
from groundwire.plans.workspace import materialize, new_folder
from groundwire.sources import adapters

# Results a search asks for, by its place in the run: 0 stands for the default of 5.
_WANTED = "(i + position) % 4"


@register("cited_responses", f"""WITH {FINAL},
  {v.TOOL_RESULTS.replace(v.CALLS + ",", "")},
  {v.ALL_DOCUMENTS}{v.chunks("all_documents", ", source")},
  stored AS (SELECT chunk_id, uri, text, {letters_sql("text")} AS e FROM chunks),
  questions AS (SELECT DISTINCT {v.strip("query")} AS question FROM requests WHERE {v.strip("query")} <> ''),
  embedded AS (SELECT question, {letters_sql("question")} AS e FROM questions),
  hits AS (SELECT question, chunk_id, uri, text, round(list_distance(a.e, s.e), 6) AS distance,
    row_number() OVER (PARTITION BY question ORDER BY list_distance(a.e, s.e), chunk_id) AS rank
    FROM embedded a, stored s QUALIFY rank <= 5),
  searches AS (SELECT request_id, i, position, {v.strip("query")} AS question, CASE {_WANTED} WHEN 0 THEN 5 ELSE {_WANTED} END AS wanted
    FROM paired JOIN requests USING (request_id) WHERE tool = 'retrieve_knowledge' AND status = 'success'
      AND (request_id, i) IN (SELECT (request_id, i) FROM looped WHERE is_tool AND NOT discarded)),
  cited AS (SELECT request_id, count(*) AS n_citations,
    string_agg(concat_ws(':', i, position, rank, chunk_id, CAST(round(1000000 / (1.0 + distance * distance)) AS BIGINT)), ' ' ORDER BY i, position, rank) AS citations,
    string_agg(uri || chr(31) || substr(text, 1, 500), chr(30) ORDER BY i, position, rank) AS passages
    FROM searches JOIN hits USING (question) WHERE rank <= wanted GROUP BY 1)
  SELECT request_id, session_id, f.answer, model_tier, iterations, coalesce(n_citations, 0) AS n_citations, coalesce(citations, '') AS citations,
    sha256(coalesce(passages, '')) AS passages_sha256
  FROM final f JOIN requests USING (request_id) LEFT JOIN cited USING (request_id)""")
def cited_responses(spark, sf_dir):
    """Every run asks the index of all documents for its request's question, once per successful search; the index is
    the one an ingest left, and only the executed searches of a run are cited."""
    path = new_folder(spark, "cited-index")
    documents = versioned(adapters.table(spark, sf_dir, "documents"), F.col("text"), 1)
    ingestion.ingest_knowledge(documents, path, letter_embedder)
    knowledge_index.refresh_index(spark, path)
    run = materialize(looped(spark, sf_dir), "runs")
    question = F.struct("query", F.expr(_WANTED).alias("number_of_results"))
    paired = paired_of(run, spark, sf_dir).join(adapters.requests(spark, sf_dir).select("request_id", "query"), "request_id")
    searches = retrieval.run_searches(run, paired.withColumn("input", F.to_json(question)).drop("query"))
    citations = retrieval.cite_searches(searches, path, letter_embedder)
    final = loops.finalize_responses(run, citations=citations, config=CONFIG)

    def line(c):
        places = [c[name].cast("string") for name in ("i", "position", "rank", "chunk_id")]
        return F.concat_ws(":", *places, F.round(c["score"] * 1000000).cast("bigint").cast("string"))

    passages = F.transform("citations", lambda c: F.concat_ws("\x1f", c["source"], c["excerpt"]))
    return final.select(
        "request_id", "session_id", "answer", "model_tier", "iterations",
        F.coalesce(F.size("citations"), F.lit(0)).cast("bigint").alias("n_citations"),
        F.coalesce(F.array_join(F.transform("citations", line), " "), F.lit("")).alias("citations"),
        F.sha2(F.coalesce(F.array_join(passages, "\x1e"), F.lit("")), 256).alias("passages_sha256"),
    )
