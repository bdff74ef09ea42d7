"""JSON parsing that refuses trailing data, which the built-in parsers silently accept."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_END = "end-of-text"
DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def parse(text: Column) -> Column:
    """VARIANT of one complete JSON value, else null.

    The text is parsed as the first element of a two-element array; anything after a complete value
    breaks the array or moves the closing mark. Of duplicate keys the last counts, which is a setting of the
    session in Spark.
    """
    SparkSession.active().conf.set(DUPLICATES, "true")
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    closes = F.try_variant_get(wrapped, "$[1]", "string") == F.lit(_END)
    return F.when(closes, F.variant_get(wrapped, "$[0]", "variant"))


def kind(value: Column) -> Column:
    """Leading word of a VARIANT's type: OBJECT, ARRAY, STRING, BIGINT, VOID…; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def member(value: Column, path: str, data_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, data_type)
