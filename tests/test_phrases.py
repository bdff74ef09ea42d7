"""Phrase lists against a search at every place."""

import random
import time

import pytest
from pyspark.sql import functions as F

from groundwire.operators import phrases, policy

ENTITIES = ("NAME", "ADDRESS")
CASES = [
    ("Annabel met Anna Smith and ann.", "Annabel met {NAME} and {NAME}."),
    ("ANN  SMITH-JONES, ann\nsmith", "{NAME}-JONES, {NAME}"),
    ("joann ann_x annö Ann", "joann ann_x annö {NAME}"),
    ("at 5 Main St. (HQ)! 15 Main St. (HQ)", "at {ADDRESS}! 15 Main St. (HQ)"),
    ("Ann Smith Road 7", "{ADDRESS}"),  # the longest of all lists
    ("Road 7 Ann Smith Road 8", "Road 7 {NAME} Road 8"),
    ("Ann Ann Smith Ann", "{NAME} {NAME} {NAME}"),
    ("mail ann@x.org {EMAIL} ann {email}", "mail {EMAIL} {EMAIL} {NAME} {email}"),
    ("Ünal ÜNAL ünals", "{NAME} {NAME} ünals"), ("", ""), (None, None), ("nothing here", "nothing here"),
]
LISTS = {"NAME": ["Ann", "Ann Smith", "Anna Smith", "Ünal", None, "", " ", "Ann"], "ADDRESS": ["5 Main St. (HQ)", "Ann Smith Road 7"]}


def as_table(spark):
    rows = [(entity, phrase) for entity, own in LISTS.items() for phrase in own] + [("OTHER", "nothing")]
    return spark.createDataFrame(rows, "entity string, phrase string").withColumn("text", F.lit("x"))


@pytest.mark.parametrize("block", [200_000, 2])
def test_masks_are_whole_words(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", block)  # several tries give the same
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)], "n int, text string")
    for lists in (LISTS, as_table(spark)):
        got = policy.anonymize(df, "text", lists=lists).orderBy("n").collect()
        assert [r.masked for r in got] == [m for _, m in CASES]
        assert [r.anonymized for r in got] == [None if t is None else t != m for t, m in CASES]
    assert policy.anonymize(df.limit(0), "text", lists=LISTS).collect() == []


def plain_spans(text, lists):
    """Every phrase tried at every place."""
    found = [(m.start(), m.end(), m.group().lower()) for m in phrases.TOKEN.finditer(text)]
    out = set()
    for n, entity in enumerate(ENTITIES):
        own = [tuple(phrases.tokens_of(p)) for p in lists[entity]]
        for at in range(len(found)):
            fits = [p for p in own if p and tuple(t for *_, t in found[at : at + len(p)]) == p]
            if fits:
                out.add((found[at][0], found[at + max(map(len, fits)) - 1][1], n))
    return out


def test_spans_of_random_texts():
    draw = random.Random(6)
    words = ["a", "b", "ab", "c", ".", "d's", "B"]
    for _ in range(200):
        lists = {e: [" ".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(6)] for e in ENTITIES}
        text = "".join(draw.choice(words) + draw.choice(["", " ", "\n "]) for _ in range(25))
        (trie,) = phrases.tries(lists, ENTITIES)
        assert set(trie.spans(text)) == plain_spans(text, lists)
        kept = phrases.merged(trie.spans(text))
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))


def test_a_hundred_thousand_phrases(spark):
    listed = spark.range(120_000).select(
        F.when(F.col("id") % 2 == 0, "NAME").otherwise("ADDRESS").alias("entity"),
        F.concat(F.lit("first"), F.col("id") % 4000, F.lit(" second"), F.col("id")).alias("phrase"),
    )
    texts = [f"say First{n % 4000} second{n} and first{n % 4000} second{n}0 x" for n in range(0, 120_000, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    began = time.time()
    got = policy.anonymize(df, "text", lists=listed).orderBy("n").collect()
    assert time.time() - began < 120
    for row in got:
        n = 40 * row.n
        tail = f"first{n % 4000} second{n}0"
        known = 0 < 10 * n < 120_000 and 10 * n % 4000 == n % 4000
        assert row.masked == f"say {{NAME}} and {'{NAME}' if known else tail} x"


def test_matches_and_topics(spark):
    df = spark.createDataFrame([(1, "Ann and ann smith at 5 main st. (hq)"), (2, "planned"), (3, None)], "id int, text string")
    got = sorted(map(tuple, phrases.phrase_matches(df, "text", LISTS, ENTITIES).collect()))
    assert got == [(1, "ADDRESS", 1), (1, "NAME", 2)]
    topics = phrases.screen_topic_lists(df, "text", LISTS, ("ADDRESS", "NAME")).orderBy("id").collect()
    assert [r.topics for r in topics] == [["ADDRESS", "NAME"], [], None]
    assert [r.topics for r in phrases.screen_topic_lists(df, "text", {}, ("NAME",)).orderBy("id").collect()] == [[], [], None]
