"""Access log scan: route normalisation and outcome by route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The routes each service answers.
QUERY_ROUTES = (
    "GET /health", "GET /v1/health", "POST /v1/query", "POST /query",
    "POST /v1/uploads/presign", "POST /uploads/presign",
)
INGEST_ROUTES = (
    "POST /v1/documents/presign", "POST /documents/presign", "POST /v1/ingest", "POST /ingest",
)


def route_key(method: Column, path: Column, stage: Column) -> Column:
    """``METHOD /path`` without the stage prefix and trailing slashes."""
    verb = F.upper(F.when(F.coalesce(method, F.lit("")) != "", method).otherwise("GET"))
    full = F.when(F.coalesce(path, F.lit("")) != "", path).otherwise("/")
    staged = (F.coalesce(stage, F.lit("")) != "") & full.startswith(
        F.concat(F.lit("/"), stage, F.lit("/"))
    )
    local = F.when(staged, F.substring(full, F.length(stage) + 2, F.length(full))).otherwise(full)
    bare = F.rtrim(local, F.lit("/"))
    return F.concat(verb, F.lit(" "), F.when(bare == "", "/").otherwise(bare))


def service_of(route: Column) -> Column:
    return (
        F.when(route.startswith("OPTIONS "), "preflight")
        .when(route.isin(*QUERY_ROUTES), "query")
        .when(route.isin(*INGEST_ROUTES), "ingest")
        .otherwise("unknown")
    )


def with_routes(log: DataFrame) -> DataFrame:
    """Add route, service and the status a caller sees (404 for unknown routes)."""
    routed = log.withColumn("route", route_key(F.col("method"), F.col("path"), F.col("stage")))
    routed = routed.withColumn("service", service_of(F.col("route")))
    return routed.withColumn(
        "outcome", F.when(F.col("service") == "unknown", F.lit(404)).otherwise(F.col("status")).cast("bigint")
    )


def access_log_scan(log: DataFrame) -> DataFrame:
    return with_routes(log).groupBy("route", "service", "outcome").agg(F.count("*").alias("calls"))
