"""Request scan: parse JSON bodies and report every contract violation per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.config import (
    MAX_BASE64_CHARS,
    MAX_QUERY_CHARS,
    MAX_SESSION_CHARS,
    MAX_URL_CHARS,
)
from groundwire.functions import strict_json
from groundwire.functions.text import compute_once

# Accepted image formats.
IMAGE_FORMATS = ("png", "jpeg", "gif", "webp")


def _text_problems(body: Column, field: str, limit: int, *, required: bool = False) -> list[Column]:
    value = strict_json.member(body, f"$.{field}")
    kind = strict_json.kind(value)
    length = F.char_length(strict_json.member(body, f"$.{field}", "string"))
    is_text = kind == "STRING"
    present = kind.isNotNull()
    problems = [
        F.when(present & (kind != "STRING") & (F.lit(required) | (kind != "VOID")), f"{field}: not a string"),
        F.when(is_text & (length > limit), f"{field}: too long"),
    ]
    if required:
        problems += [
            F.when(~F.coalesce(present, F.lit(False)), f"{field}: missing"),
            F.when(is_text & (length < 1), f"{field}: too short"),
        ]
    return problems


def _image_problems(body: Column) -> list[Column]:
    kind = strict_json.kind(strict_json.member(body, "$.image"))
    problems = [F.when(kind.isNotNull() & ~kind.isin("OBJECT", "VOID"), "image: not an object")]
    for part in ("bucket", "key"):
        part_kind = strict_json.kind(strict_json.member(body, f"$.image.{part}"))
        problems += [
            F.when((kind == "OBJECT") & part_kind.isNull(), f"image.{part}: missing"),
            F.when((kind == "OBJECT") & (part_kind != "STRING"), f"image.{part}: not a string"),
        ]
    return problems


def _other_problems(body: Column) -> list[Column]:
    fmt = strict_json.member(body, "$.image_format")
    fmt_kind = strict_json.kind(fmt)
    fmt_text = strict_json.member(body, "$.image_format", "string")
    meta_kind = strict_json.kind(strict_json.member(body, "$.metadata"))
    meta = strict_json.member(body, "$.metadata", "map<string,variant>")
    return [
        F.when(
            fmt_kind.isNotNull() & (fmt_kind != "VOID")
            & ((fmt_kind != "STRING") | ~fmt_text.isin(*IMAGE_FORMATS)),
            "image_format: not allowed",
        ),
        F.when(meta_kind.isNotNull() & (meta_kind != "OBJECT"), "metadata: not an object"),
        F.when(
            F.exists(F.map_values(meta), lambda v: ~F.coalesce(strict_json.kind(v) == "STRING", F.lit(False))),
            "metadata: value not a string",
        ),
    ]


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add the request fields and ``reasons``, the list of all violations (empty when valid).

    An empty body counts as an empty object. The one-image rule is reported only for rows whose
    fields are all acceptable. Undeclared fields are dropped.
    """
    raw = F.when(F.coalesce(F.col(body), F.lit("")) == "", F.lit("{}")).otherwise(F.col(body))
    parsed = compute_once(bodies, {"_json": strict_json.parse(raw)})
    json = F.col("_json")
    is_object = strict_json.kind(json) == "OBJECT"
    field_problems = [
        F.when(json.isNull(), "body: not valid JSON"),
        F.when(json.isNotNull() & ~F.coalesce(is_object, F.lit(False)), "body: not an object"),
        *[
            F.when(is_object, p)
            for p in (
                *_text_problems(json, "query", MAX_QUERY_CHARS, required=True),
                *_text_problems(json, "session_id", MAX_SESSION_CHARS),
                *_image_problems(json),
                *_text_problems(json, "image_url", MAX_URL_CHARS),
                *_text_problems(json, "image_base64", MAX_BASE64_CHARS),
                *_other_problems(json),
            )
        ],
    ]

    def text(field: str) -> Column:
        return strict_json.member(json, f"$.{field}", "string").alias(field)

    image = F.when(
        strict_json.kind(strict_json.member(json, "$.image")) == "OBJECT",
        F.struct(
            strict_json.member(json, "$.image.bucket", "string").alias("bucket"),
            strict_json.member(json, "$.image.key", "string").alias("key"),
        ),
    )
    metadata = F.coalesce(
        strict_json.member(json, "$.metadata", "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    others = [c for c in bodies.columns if c != body]
    fields = compute_once(parsed.select(*others, "_json"), {
        "query": text("query"), "session_id": text("session_id"), "image": image,
        "image_url": text("image_url"), "image_base64": text("image_base64"),
        "image_format": text("image_format"), "metadata": metadata,
        "_problems": F.array_compact(F.array(*field_problems)),
    }).drop("_json")
    n_sources = (
        F.col("image").isNotNull().cast("int")
        + (F.coalesce(F.col("image_url"), F.lit("")) != "").cast("int")
        + (F.coalesce(F.col("image_base64"), F.lit("")) != "").cast("int")
    )
    reasons = F.when(
        (F.size("_problems") == 0) & (n_sources > 1), F.array(F.lit("more than one image source"))
    ).otherwise(F.col("_problems"))
    return fields.withColumn("reasons", reasons).drop("_problems")


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines request files as (valid, rejected); rejected rows keep all reasons."""
    parsed = parse_requests(spark.read.text(path).withColumnRenamed("value", "body"))
    valid = parsed.filter(F.size("reasons") == 0).drop("reasons")
    return valid, parsed.filter(F.size("reasons") > 0)


def has_image(df: DataFrame) -> Column:
    """True when any of the three image sources is given; columns a table lacks count as absent."""
    found = F.lit(False)
    if "image" in df.columns:
        found = found | F.col("image").isNotNull()
    for field in ("image_url", "image_base64"):
        if field in df.columns:
            found = found | (F.coalesce(F.col(field), F.lit("")) != "")
    return found
