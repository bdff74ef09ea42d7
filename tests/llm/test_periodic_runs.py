"""Runs from suffix trees against a comparison of all places at all distances."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundwire.llm import periodic_runs
from groundwire.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, times=3):
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], "i8")
    out = []
    for q in range(1, len(w) // times + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length = b - a + q
            part = w[a : a + length]
            if length >= max(least, times * q) and not any((part[:-r] == part[r:]).all() for r in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_whole_documents(spark):
    from groundwire.llm import queries  # noqa: F401  fills the registry

    texts = pd.read_parquet(f"{SF_DIR}/documents.parquet").set_index("doc_id").text
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    with_runs = 0
    for doc_id, text in texts.items():
        words, row = planted(doc_id, WORD.findall(text or "")), got[doc_id]
        runs = plain_runs(words)
        with_runs += bool(runs)
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert with_runs > 5


@pytest.mark.parametrize("least, times", [(24, 3), (9, 3), (6, 2), (10, 5)])
def test_all_runs_of_random_sequences(least, times):
    draw = random.Random(least)
    for _ in range(250):
        letters, few = [], draw.choice([1, 2, 2, 3, 5])
        while len(letters) < 120:
            block = [draw.randrange(few) for _ in range(draw.randint(1, 9))]
            letters += block * draw.randint(1, 9) if draw.random() < 0.6 else [draw.randrange(9) for _ in block]
        words = [f"w{x}" for x in letters]
        ((n, found, _),) = periodic_runs._marked([" ".join(words)], least, times)
        assert n == len(words) and found == plain_runs(words, least, times)
        # the cut into stretches changes nothing
        assert periodic_runs.runs_of(np.array(letters), least, times) == found


def test_odd_texts(spark):
    long = " ".join(f"w{n % 7}" for n in range(20_000)) + " end"
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "A a " * 12, "a b " * 24, long, long, "x " * 5 + "a b " * 12 + "y"]
    given = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumns({"runs": F.lit("mine"), "start": F.lit(1)})
    marked = periodic_runs.with_runs(given, "text")
    rows = marked.orderBy("n").collect()
    assert marked.columns == ["n", "text", "runs", "start", "n_words", "collapsed"]
    for row, text in zip(rows, texts, strict=True):
        words = WORD.findall(text or "")
        assert row.n_words == len(words) and [tuple(r) for r in row.runs] == plain_runs(words) and row.text == text
    assert rows[4].runs == [] and tuple(rows[5].runs[0]) == (0, 24, 1) and rows[5].collapsed == "a"
    assert rows[8].runs == rows[9].runs and rows[8].collapsed == " ".join(f"w{n}" for n in range(7)) + " end"
    assert rows[10].collapsed == "x x x x x a b y"
    assert periodic_runs.with_runs(given.filter("n < 0"), "text").collect() == []


def test_plant_of_odd_ids(spark):
    odd = next(n for n in range(100) if zlib.crc32(str(n).encode()) % 10 == 0)
    words = [f"w{n}" for n in range(50)]
    given = [(odd, " ".join(words)), (odd, None), (odd, ""), (odd, "one"), (None, "a b"), (-7, "a b")]
    rows = periodic_runs.with_planted_runs(spark.createDataFrame(given, "id long, text string"), "id", "text").collect()
    assert [r.text for r in rows] == [" ".join(planted(odd, words)), None, "", "one", "a b", "a b"]


def test_ties_of_the_strongest_run(spark):
    runs = "array(named_struct('start', {}L, 'length', {}L, 'period', {}L), named_struct('start', {}L, 'length', {}L, 'period', {}L))"
    for a, b, best in (((0, 30, 1), (50, 30, 1), 0), ((0, 30, 2), (40, 60, 4), 0), ((0, 30, 2), (40, 31, 2), 40)):
        row = spark.range(1).withColumn("r", F.expr(runs.format(*a, *b))).select(periodic_runs.strongest("r").alias("x")).first()
        assert row.x.start == best
