"""The search by two trees against a plain scoring of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwire.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, own in asked.items():
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // total
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        rows += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=repr)


def search(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "n": F.lit(1), "score": F.lit(2)})
    i = spark.createDataFrame(items, "item_id int, text string").withColumns({"doc_id": F.lit("x"), "rank": F.lit(1)})
    got = dual_tree.top_documents(d, i, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = [f"w{n}" for n in range(400)]

    def text(n, base):
        return " ".join(draw.choice(words[base : base + 60]) if draw.random() < 0.7 else draw.choice(words[:9]) for _ in range(n))

    docs = [(n, text(draw.randint(1, 80), 40 * (n % 8))) for n in range(900)]
    docs += [(900 + n, docs[n][1]) for n in range(30)]  # ties
    return docs, [(n, text(12, 40 * (n % 8))) for n in range(25)]


def test_against_all_pairs(spark, corpus, monkeypatch):
    docs, items = corpus
    assert search(spark, docs, items, 10) == plain(docs, items, 10)
    monkeypatch.setattr(dual_tree, "BLOCK_TERMS", 60)  # several blocks of items
    assert search(spark, docs, items, 10) == plain(docs, items, 10)


def test_odd_rows(spark):
    long = " ".join(f"tok{n % 997}" for n in range(20_000))
    docs = [
        (1, None), (2, ""), (3, " -- !!"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha beta"), (None, "alpha beta"), (6, long), (7, long),
        (8, "école ÉCOLE alpha"), (9, "x\x7fy_z"), (10, "unrelated text"),
    ]
    items = [(1, "alpha, beta?"), (1, "alpha, beta?"), (2, None), (3, ""), (4, "tok5 tok6 alpha"), (None, "École école"), (5, "y z"), (6, "none such"), (7, "alpha"), (7, "beta")]
    for k in (2, 50):
        assert search(spark, docs, items, k) == plain(docs, items, k)
    assert search(spark, [], items, 5) == [] and search(spark, docs, [], 5) == [] and search(spark, docs[:3], items, 5) == []


def test_batches_are_passed_over(corpus, monkeypatch):
    """Most pairs are never scored, and the walk finds what scoring all finds."""
    docs, items = corpus
    monkeypatch.setattr(dual_tree, "LEAF", 8)
    draw = np.random.default_rng(4)
    vocabulary, n = 400, 4000
    first = np.sort(draw.integers(0, 40, n))  # neighbours share their terms
    own = [np.unique(np.concatenate([f * 10 + draw.integers(0, 10, 6), draw.integers(0, vocabulary, 2)])) for f in first]
    owner, term = np.repeat(np.arange(n), list(map(len, own))), np.concatenate(own)
    impact = draw.integers(1, 1000, len(term)).astype("f8")
    asked = [np.unique(f * 10 + draw.integers(0, 10, 5)) for f in range(40)]
    tree = dual_tree.ItemTree(asked, np.ones(vocabulary))
    walk = dual_tree.Search(tree, 5, np.zeros(40))
    walk.walk(dual_tree.DocumentTree(owner, term, impact, vocabulary), np.arange(n), np.zeros(n, "?"))
    table = np.zeros((n, vocabulary))
    table[owner, term] = impact
    for at, (score, _, ids) in zip(tree.order, walk.best):
        every = table[:, asked[at]].sum(axis=1)
        want = np.lexsort((np.arange(n), -every))[:5]
        assert sorted(ids.tolist()) == sorted(want.tolist()) and sorted(score) == sorted(every[want])
    assert walk.scored < 0.2 * n * 40


def test_chunks_keep_all_rows():
    import pyarrow as pa

    lists = [list(range(n % 7)) for n in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "terms"])
    for size, postings in ((8192, 10**6), (7, 10**6), (8192, 5), (3, 4)):
        dual_tree.CHUNK, dual_tree.CHUNK_POSTINGS, before = size, postings, (dual_tree.CHUNK, dual_tree.CHUNK_POSTINGS)
        try:
            chunks = list(dual_tree._chunks(iter([batch.slice(0, 33), batch.slice(33)])))
        finally:
            dual_tree.CHUNK, dual_tree.CHUNK_POSTINGS = before
        assert [x for c in chunks for x in c.column("doc_id").to_pylist()] == list(range(100))
        assert all(c.num_rows <= size for c in chunks) and [x for c in chunks for x in c.column("terms").to_pylist()] == lists
