"""Sensitive-data patterns as column expressions (no lookaround, so any linear engine agrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types the policy masks, in masking order.
ENTITY_TYPES = (
    "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "CREDIT_DEBIT_CARD_NUMBER", "US_SOCIAL_SECURITY_NUMBER",
    "EMAIL", "PHONE", "NAME", "ADDRESS",
)
PATTERNS = {
    "AWS_ACCESS_KEY": "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "AWS_SECRET_KEY": "(?i)aws_?secret_?(?:access_?)?key[\"']? *[=:] *[\"']?[A-Za-z0-9/+]{40}",
    "CREDIT_DEBIT_CARD_NUMBER": "[0-9](?:[ -]?[0-9]){12,15}",
    "US_SOCIAL_SECURITY_NUMBER": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "EMAIL": "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}[.][A-Za-z]{2,24}",
    "PHONE": "(?:[+]?[0-9]{1,3}[ .-])?[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}",
}
# A text without these cannot match; the test is far cheaper than the pattern.
REQUIRED = {
    "AWS_ACCESS_KEY": "AKIA|ASIA",
    "AWS_SECRET_KEY": "(?i)aws",
    "CREDIT_DEBIT_CARD_NUMBER": "[0-9][0-9 -]{12}",
    "US_SOCIAL_SECURITY_NUMBER": "[0-9]{3}-[0-9]{2}",
    "EMAIL": "@",
    "PHONE": "[0-9]{3}[)]?[ .-][0-9]{3}",
}
SEVERITY = {
    "AWS_ACCESS_KEY": "high", "AWS_SECRET_KEY": "high", "CREDIT_DEBIT_CARD_NUMBER": "high",
    "US_SOCIAL_SECURITY_NUMBER": "high", "EMAIL": "medium", "PHONE": "medium", "NAME": "low",
    "ADDRESS": "low",
}
CARD = "CREDIT_DEBIT_CARD_NUMBER"


def luhn_valid(candidate: Column) -> Column:
    """Luhn check over the digits of a candidate card number."""
    digits = F.split(F.reverse(F.regexp_replace(candidate, "[^0-9]", "")), "")

    def weighted(digit: Column, position: Column) -> Column:
        value = digit.cast("int")
        doubled = value * 2
        return F.when(position % 2 == 0, value).when(doubled > 9, doubled - 9).otherwise(doubled)

    # A negative limit would keep an empty trailing part; digits are non-empty here.
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), weighted), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def may_match(text: Column, entity: str) -> Column:
    return text.rlike(REQUIRED[entity])


def matches(text: Column, entity: str) -> Column:
    """All matches of a type; null for texts that cannot hold one."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[entity]), F.lit(0))
    return F.when(may_match(text, entity), F.filter(found, luhn_valid) if entity == CARD else found)


def mask(text: Column) -> Column:
    """Replace each match by ``{TYPE}``, for the types that have a pattern; the others come from phrase lists."""
    masked = text
    for entity in filter(PATTERNS.__contains__, ENTITY_TYPES):
        token = "{" + entity + "}"
        if entity == CARD:
            replaced = F.aggregate(
                F.array_distinct(matches(masked, entity)), masked,
                lambda done, card: F.replace(done, card, F.lit(token)),  # noqa: B023
            )
            masked = F.when(may_match(text, entity), replaced).otherwise(masked)
        else:
            # Masking only ever removes characters a pattern needs, so the original text decides.
            replaced = F.regexp_replace(masked, PATTERNS[entity], token)
            masked = F.when(may_match(text, entity), replaced).otherwise(masked)
    return masked
