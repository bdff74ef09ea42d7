"""The registered queries against SQL, or against brute force where SQL cannot say it."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from compare import mismatch, oracle_connection

import corpus_pipeline
from groundwire.llm import byte_bpe, language, queries, source_mix  # noqa: F401  fills the registry
from groundwire.llm.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(spark, name):
    return QUERIES[name](spark, SF_DIR)


def shingles(text, n):
    words = WORD.findall(text or "")
    return {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert mismatch(run(spark, name), oracle_connection(SF_DIR), ORACLES[name]) is None


def test_fingerprints(spark, documents):
    got = run(spark, "op1_fingerprints").toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = documents.text.fillna("").tolist()
    errors = []
    for n, text in enumerate(texts):
        after, half = texts[(n + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got.iloc[n]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, row.near_edited), (after, row.near_next)):
            a, b = shingles(text, 5), shingles(other, 5)
            errors.append(near - len(a & b) / max(1, len(a | b)))
    errors = pd.Series(errors)
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.04 and errors.abs().max() < 0.2
    assert (got.fingerprint.groupby(texts).nunique() == 1).all()


def test_language_is_right_on_held_out_documents(spark, documents):
    got = run(spark, "op3_language").toPandas().merge(documents, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda n: zlib.crc32(str(n).encode()) % 4 == 2)).all()
    assert (got.lang == got.lang_pred)[got.held_out & got.lang.notna()].mean() > 0.98 and got.score.between(0, 1).all()


def test_language_equals_plain_mixtures(spark, documents):
    """The best single language by likelihood, and the shares of a second one by plain expectation-maximisation."""
    held = documents.doc_id.map(lambda n: zlib.crc32(str(n).encode()) % 4 == 2)
    learned = spark.createDataFrame(documents[~held])
    model = language.fit(learned, "text", "lang")
    letters = language._letters()
    counts = np.full((language.BUCKETS, len(model.languages)), 0.05)
    for text, lang in zip(documents.text[~held], documents.lang[~held]):
        if lang is not None:
            np.add.at(counts[:, model.languages.index(lang)], language.trigrams([text or ""], letters)[0], 1)
    assert np.allclose(model.chances, counts / counts.sum(axis=0))
    texts = [t or "" for t in documents.text]
    texts += [a + "\n" + b for a, b in zip(texts[:40], texts[40:80])]  # mixtures
    found = language.infer(texts, model, letters, 2.0)
    several = 0
    for text, shares in zip(texts, found):
        bucket = language.trigrams([text], letters)[0]
        if not len(bucket):
            assert not shares.any()
            continue
        chance = model.chances[bucket]
        single = np.log(chance).sum(axis=0)
        used = np.flatnonzero(shares)
        if len(used) == 1:
            assert single[used[0]] >= single.max() - 1e-6
            continue
        several += 1
        part = np.full(len(used), 1 / len(used))
        for _ in range(400):
            weight = chance[:, used] * part
            part = (weight / weight.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.abs(part - shares[used]).max() < 0.03
        gain = np.log(chance[:, used] @ part).sum() - single.max()
        assert gain > 2.0 * np.log(len(bucket) + 1)  # worth its penalty
    assert several >= 10


def test_source_mix_equals_a_plain_queue(spark, documents):
    """Targets by pouring, one copy after the other by finish time, until the budget is spent."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = source_mix.mix(docs).toPandas()
    sizes = documents.set_index("doc_id").text.map(lambda t: len(WORD.findall(t or "")))
    assert (rows.set_index("doc_id")["size"].sort_index() == sizes.sort_index()).all()
    total = rows.groupby("source")["size"].sum().sort_index()
    weights, budget, target = {s: (5, 2, 1)[n % 3] for n, s in enumerate(total.index)}, 1.5 * total.sum(), dict.fromkeys(total.index, 0.0)
    left, open_ = budget, set(total.index)
    while open_ and left > 1e-9:
        step = min(left / sum(weights[s] for s in open_), min((2 * total[s] - target[s]) / weights[s] for s in open_))
        for s in open_:
            target[s] += step * weights[s]
        left -= step * sum(weights[s] for s in open_)
        open_ = {s for s in open_ if 2 * total[s] - target[s] > 1e-6}
    assert all(abs(target[s] - t) < 1e-3 for s, t in zip(rows.source, rows.target))
    queue = []
    for source, own in rows[rows["size"] > 0].groupby("source"):
        sent = own.sort_values(["place", "doc_id"])["size"].cumsum()
        for copy in (1, 2):
            queue += [((x + (copy - 1) * int(total[source])) / own.target[n], own.place[n], copy, n) for n, x in sent.items()]
    spent, copies = 0, dict.fromkeys(rows.index, 0)
    for _, _, _, n in sorted(queue):
        spent += rows["size"][n]
        if spent > budget:
            break
        copies[n] += 1
    assert [copies[n] for n in rows.index] == rows.copies.tolist()


def test_source_mix_meets_its_targets(spark, documents):
    got = run(spark, "op4_source_mix").toPandas()
    sizes = documents.text.map(lambda t: len(WORD.findall(t or ""))).groupby(documents.source).sum()
    budget = 1.5 * sizes.sum()
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes.index))}
    full, want = set(), {}
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        over = {s for s, w in weights.items() if s not in full and level * w > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 2 * sizes[s] if s in full else level * w for s, w in weights.items()}
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"), size=("source_size", "first"))
    assert (by["size"] == sizes).all() and (got.taken <= 2 * got["size"]).all()
    for source, row in by.iterrows():
        assert row.target == pytest.approx(want[source]) and abs(row.taken - row.target) <= 2 * row.largest
    again = run(spark, "op4_source_mix").toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_byte_bpe_equals_the_reference_library(spark, documents, encoding):
    texts = dict(zip(documents.doc_id, documents.text.fillna("")))
    for row in run(spark, "op6_byte_bpe").collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    got = run(spark, "op7_quality").toPandas().merge(pd.read_parquet(f"{SF_DIR}/labels.parquet"), on="doc_id")
    assert got.kept[got.quality == 1].mean() > 0.97 and (~got.kept[got.quality == 0]).mean() > 0.9


def test_pages_survive_the_archive(spark):
    pages = pd.read_parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r for r in run(spark, "op8_warc").collect()}
    assert len(got) == len(pages)
    first = {}
    for page_id, html in sorted(zip(pages.page_id, pages.html.fillna(""))):
        first.setdefault(html, page_id)
        row = got[page_id]
        assert row.payload_bytes == len(html.encode())
        assert (row.record_type, row.refers_to) == (("response", None) if first[html] == page_id else ("revisit", first[html]))


def linked(documents, n, percent):
    """Smallest member of each document's component, by comparing all pairs that share a shingle."""
    sets = {i: shingles((t or "").translate(LOWER), n) for i, t in zip(documents.doc_id, documents.text)}
    holders, parent = {}, {i: i for i in sets}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        for j, both in Counter(j for s in own for j in holders[s] if j > i).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: root(i) for i in sets}


def test_minhash_components_equal_brute_force(spark, documents):
    sets, component = linked(documents, 3, 85)
    for row in run(spark, "op9_minhash_links").collect():
        assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), component[row.doc_id])
        assert row.kept == (row.doc_id == row.component_id)


def test_pipeline_stages(spark, documents, encoding):
    """Each stage against its own rule, on what the one before it kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_DIR)
        kept[name] = done.toPandas()
        if name != "byte_pair_encoding":
            assert done.columns == docs.columns
            docs = spark.createDataFrame(kept[name], docs.schema)
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet").set_index("doc_id").quality
    after = kept["quality"]
    assert labels.reindex(after.doc_id).dropna().mean() > 0.98
    assert set(labels[labels == 1].index) <= set(after.doc_id) | set(labels[labels == 1].index[:3])

    seen, texts = {}, {}
    lines = [(line.strip(" \t\n\x0b\x0c\r").translate(LOWER), i) for i, t in zip(after.doc_id, after.text) for line in (t or "").split("\n")]
    for key, i in lines:
        seen[key] = min(seen.get(key, i), i)
    for i, t in zip(after.doc_id, after.text):
        keys = [(line, line.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for line in (t or "").split("\n")]
        texts[i] = "\n".join(line for line, key in keys if len(key) < 10 or seen[key] == i)
    got = kept["line_dedup"]
    assert dict(zip(got.doc_id, got.text.fillna(""))) == texts and (got.n_chars == got.text.str.len()).all()

    # near copies are those of the texts before lines were taken out
    _, component = linked(documents[documents.doc_id.isin(got.doc_id)], 5, 80)
    assert set(kept["minhash_dedup"].doc_id) == {i for i, c in component.items() if i == c}
    _, late = linked(got, 5, 80)
    assert sum(i != c for i, c in component.items()) > sum(i != c for i, c in late.items())
    mixed = kept["source_mix"].doc_id.value_counts()
    assert mixed.max() <= 2 and set(mixed.index) <= set(kept["minhash_dedup"].doc_id)
    last = kept["byte_pair_encoding"]
    assert last.round_trip.all() and len(last) == mixed.sum()
    assert last.n_tokens.tolist() == [len(encoding.encode_ordinary(texts[i])) for i in last.doc_id]
