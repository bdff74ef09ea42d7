"""Phrase lists: names, addresses, topics found as whole words, however long the lists are.

A text is cut into tokens: words (letters, digits, underscores), single other characters, and masks like ``{EMAIL}``
as one token; blanks only separate. A phrase is found where its tokens follow each other, in any letter case, so
never inside a word. Lists become tries of tokens that are broadcast, at most BLOCK_TOKENS tokens in each, so that no
broadcast grows with the lists; the texts pass all tries in the same tasks, without a shuffle. A task holds all of
them, about 250 bytes a token: lists of a million phrases take some hundred megabytes. At each place the longest
phrase of each list counts. For masking, what is found is merged over all lists from left to
right: the earliest phrase, of those the longest, of those the list named first; phrases that overlap it are left.

Phrases that are null or hold no token match nothing; repeated phrases count once; a phrase may be in several lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.functions.sensitive import ENTITY_TYPES

BLOCK_TOKENS = 200_000
TOKEN = re.compile(r"\{(?:" + "|".join(ENTITY_TYPES) + r")\}|\w+|[^\w\s]")
SPANS = "array<struct<start:int,end:int,entity:int>>"

Lists = Mapping[str, Iterable[str]] | DataFrame


def tokens_of(phrase: str | None) -> list[str]:
    return TOKEN.findall(phrase.lower()) if phrase else []


class Trie:
    """Phrases by their tokens: (node, token) to the next node, and the lists that a node ends a phrase of."""

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.below: dict[tuple[int, str], int] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.size = 0

    def add(self, tokens: Sequence[str], entity: int) -> None:
        node = self.first.setdefault(tokens[0], len(self.below) + len(self.first) + 1)
        for token in tokens[1:]:
            node = self.below.setdefault((node, token), len(self.below) + len(self.first) + 1)
        self.ends[node] = tuple(sorted({*self.ends.get(node, ()), entity}))
        self.size += len(tokens)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, list): the longest phrase of each list at each place."""
        first, below, ends = self.first, self.below, self.ends
        found = [(m.start(), m.end(), m.group().lower()) for m in TOKEN.finditer(text)]
        out = []
        for at, (start, end, token) in enumerate(found):
            node = first.get(token)
            if node is None:
                continue
            longest = {}
            while True:
                for entity in ends.get(node, ()):
                    longest[entity] = end
                at += 1
                node = below.get((node, found[at][2])) if at < len(found) else None
                if node is None:
                    break
                end = found[at][1]
            out.extend((start, stop, entity) for entity, stop in sorted(longest.items()))
        return out


def _phrases(lists: Lists, entities: Sequence[str]) -> Iterator[tuple[str, str]]:
    if isinstance(lists, DataFrame):
        rows = lists.select(F.col("entity").cast("string"), F.col("phrase").cast("string")).filter(F.col("entity").isin(*entities))
        yield from map(tuple, rows.dropDuplicates().toLocalIterator())
    else:
        yield from ((entity, phrase) for entity, phrases in lists.items() for phrase in phrases)


def tries(lists: Lists, entities: Sequence[str]) -> Iterator[Trie]:
    """The lists (columns entity and phrase, or phrases by entity) as tries of bounded size."""
    place = {entity: n for n, entity in enumerate(entities)}
    trie = Trie()
    for entity, phrase in _phrases(lists, entities):
        tokens = tokens_of(phrase)
        if tokens:
            trie.add(tokens, place[entity])
        if trie.size >= BLOCK_TOKENS:
            yield trie
            trie = Trie()
    if trie.size:
        yield trie


def phrase_spans(text: Column, lists: Lists, entities: Sequence[str]) -> Column:
    """All places of phrases in ``text`` as structs start, end (characters from 0) and number of the list; null for
    null. The tries are built now and broadcast."""
    context = SparkSession.active().sparkContext
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "entity")]))

    def finder(trie: Trie):
        shared = context.broadcast(trie)

        @F.arrow_udf(SPANS)
        def find(texts: pa.Array) -> pa.Array:
            spans = shared.value.spans
            rows = (each.as_py() for each in texts)
            return pa.array([None if t is None else [dict(zip(("start", "end", "entity"), s)) for s in spans(t)] for t in rows], kind)

        return find(text)

    found = [finder(trie) for trie in tries(lists, entities)]
    nothing = F.when(text.isNotNull(), F.array().cast(SPANS))
    return reduce(lambda a, b: F.concat(a, b), found) if found else nothing


def merged(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans from left to right, the longest first at one place, none overlapping another."""
    kept: list[tuple[int, int, int]] = []
    for start, end, entity in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end, entity))
    return kept


def mask_phrases(text: Column, lists: Lists, entities: Sequence[str]) -> Column:
    """``text`` with every phrase replaced by its list's name in braces."""
    names = [f"{{{entity}}}" for entity in entities]

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            if found:
                pieces, at = [], 0
                for start, end, entity in merged((s["start"], s["end"], s["entity"]) for s in found):
                    pieces += [text[at:start], names[entity]]
                    at = end
                text = "".join([*pieces, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return replaced(text, phrase_spans(text, lists, entities))


def phrase_matches(df: DataFrame, column: str, lists: Lists, entities: Sequence[str]) -> DataFrame:
    """The other columns of ``df`` with entity and matches, one row per list that a text has phrases of."""
    others = [c for c in df.columns if c != column]
    counted = df.select(*others, phrase_spans(F.col(column), lists, entities).alias("_spans"))
    counts = [
        F.struct(F.lit(entity).alias("entity"), F.size(F.filter("_spans", lambda s: s["entity"] == n)).cast("bigint").alias("matches"))  # noqa: B023
        for n, entity in enumerate(entities)
    ]
    return counted.select(*others, F.inline(F.filter(F.array(*counts), lambda c: c["matches"] > 0)))


def screen_topic_lists(df: DataFrame, column: str, lists: Lists, topics: Sequence[str]) -> DataFrame:
    """Add ``topics``: those whose listed phrases occur in the text as whole words, in the order given."""
    found = F.array_sort(F.array_distinct(F.transform(phrase_spans(F.col(column), lists, topics), lambda s: s["entity"])))
    names = F.array(*[F.lit(t) for t in topics])
    return df.withColumn("topics", F.transform(found, lambda n: F.get(names, n)))
