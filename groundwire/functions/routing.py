"""Column rules that pick a modality and a model tier for a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwire.config import FAST, REASONING
from groundwire.functions.text import contains_any, starts_with_any

# Lexicons, the code pattern, reasons and confidences of the complexity rules.
GREETINGS = (
    "hi", "hello", "hey", "thanks", "thank you", "thx", "good morning", "good afternoon",
    "good evening", "how are you", "what's up", "whats up", "yo", "ok", "okay",
)
REASONING_HINTS = (
    "analyze", "analyse", "compare", "refactor", "implement", "architecture", "step by step",
    "multi-hop", "tradeoff", "trade-off", "debug", "why does", "how should we", "design a",
    "write a function", "write code", "python", "typescript", "cdk", "lambda", "compliance",
    "synthesize", "plan the", "root cause", "evaluate", "assess this", "across documents",
    "according to our", "cite",
)
FAST_HINTS = (
    "what is", "what's", "who is", "define", "when is", "summarize this in one", "one sentence",
    "quick summary", "faq",
)
CODE_MARKERS = (
    "```", "def ", "class ", "function ", "import ", "select ", "from src/", "refactor", "unit test",
)
# Characters a case-insensitive search counts as i, s or k although lower() does not.
FOLDED_LETTERS = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))
LONG_QUERY_CHARS = 480
RETRIEVAL_HINTS = (
    "policy", "document", "manual", "according to", "knowledge", "our ", "handbook", "sop",
    "procedure", "cite", "source",
)
LOW_CONFIDENCE_MARKERS = (
    "i don't know", "i do not know", "not sure", "cannot determine", "i'm not confident",
    "insufficient information",
)
REASON_IMAGE = "multimodal image attached"
REASON_CODE = "code or refactoring intent"
REASON_HINT = "complex reasoning / multi-hop language"
REASON_LONG = "long or multi-question prompt"
REASON_GREETING = "greeting or casual chit-chat"
REASON_FAQ = "simple FAQ / one-shot lookup"
REASON_SHORT = "short prompt"
REASON_AMBIGUOUS = "ambiguous length — prefer reasoning"


def decision(tier: Column | str, reason: Column | str, source: Column | str, confidence) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(tier).alias("tier"),
        as_column(reason).alias("reason"),
        as_column(source).alias("source"),
        as_column(confidence).cast("double").alias("confidence"),
    )


def case_folded(text: Column, lowered: Column) -> Column:
    """Lower case as a case-insensitive search sees it; differs only for a few rare letters."""
    plain = text
    for letter, replacement in FOLDED_LETTERS:
        plain = F.replace(plain, F.lit(letter), F.lit(replacement))
    rare = contains_any(text, [letter for letter, _ in FOLDED_LETTERS])
    return F.when(rare, F.lower(plain)).otherwise(lowered)


def complexity_decision(
    stripped: Column, lowered: Column, folded: Column, n_words: Column, compact: Column, has_image: Column
) -> Column:
    """First matching rule wins; the inputs are prepared once per row by the caller.

    Substring scans replace the code pattern, all of whose branches are literals. ``n_words`` and
    ``compact`` may be null for texts past the length limit, which are settled before they are read.
    """

    def verdict(tier: str, reason: str, confidence: float) -> Column:
        return decision(tier, reason, "heuristic", confidence)

    padded = F.concat(F.lit(" "), lowered, F.lit(" "))
    is_greeting = compact.isin(*GREETINGS) | ((n_words <= 6) & starts_with_any(compact, GREETINGS))
    is_faq = (n_words <= 14) & (
        starts_with_any(lowered, FAST_HINTS) | contains_any(padded, [f" {h} " for h in FAST_HINTS])
    )
    questions = F.length(lowered) - F.length(F.replace(lowered, F.lit("?"), F.lit("")))
    return (
        F.when(has_image, verdict(REASONING, REASON_IMAGE, 0.97))
        .when(contains_any(folded, CODE_MARKERS), verdict(REASONING, REASON_CODE, 0.93))
        .when(contains_any(lowered, REASONING_HINTS), verdict(REASONING, REASON_HINT, 0.88))
        .when(
            (F.length(stripped) > LONG_QUERY_CHARS) | (questions >= 2) | (n_words > 80),
            verdict(REASONING, REASON_LONG, 0.78),
        )
        .when(is_greeting, verdict(FAST, REASON_GREETING, 0.96))
        .when(is_faq, verdict(FAST, REASON_FAQ, 0.84))
        .when(n_words <= 8, verdict(FAST, REASON_SHORT, 0.72))
        .otherwise(verdict(REASONING, REASON_AMBIGUOUS, 0.55))
    )


def low_confidence(answer: Column) -> Column:
    return contains_any(F.lower(answer), LOW_CONFIDENCE_MARKERS)
