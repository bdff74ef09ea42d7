"""Chunking, embedding, ingestion and retrieval."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from groundwire.operators import ingestion, retrieval
from groundwire.sources.chunk_store import read_chunks


def chunk_texts(spark, text, size=300, overlap=20):
    df = spark.createDataFrame([("s3://d/1", text)], "uri string, text string")
    return [r for r in ingestion.chunk_documents(df, size, overlap).orderBy("ordinal").collect()]


@pytest.mark.parametrize("n,starts", [(1, [0]), (300, [0]), (301, [0, 240]), (540, [0, 240]), (541, [0, 240, 480]), (5184, None)])
def test_chunk_starts(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    chunks = chunk_texts(spark, "  " + " \n".join(words) + " ")
    expected = starts or list(range(0, n - 60, 240))
    assert [c.text for c in chunks] == [" ".join(words[s:s + 300]) for s in expected]
    assert {c.n_chunks for c in chunks} == {len(expected)} and len({c.chunk_id for c in chunks}) == len(expected)


def test_blank_documents_have_no_chunks(spark):
    assert chunk_texts(spark, " \n \t") == []


@settings(max_examples=15, deadline=None)
@given(n=st.integers(1, 400), size=st.integers(2, 50), overlap=st.integers(0, 90))
def test_chunks_cover_every_token(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    chunks = [c.text.split(" ") for c in chunk_texts(spark, " ".join(words), size, overlap)]
    keep = size * overlap // 100
    rebuilt = chunks[0] + [w for c in chunks[1:] for w in c[keep:]]
    assert rebuilt == words and all(len(c) <= size for c in chunks)


def test_embedding_weights_match_plain_arithmetic(spark):
    texts = ["apple banana apple", "banana cherry", "apple durian elder fig"]
    chunks = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "chunk_id string, text string")
    got = {r.chunk_id: r.embedding for r in ingestion.embed_chunks(chunks, ingestion.fit_embedder(chunks)).collect()}
    slot = HashingTF(numFeatures=1024).indexOf
    counts = [{} for _ in texts]
    for n, t in enumerate(texts):
        for w in t.split():
            counts[n][slot(w)] = counts[n].get(slot(w), 0) + 1
    for n, terms in enumerate(counts):
        weights = {s: c * (1 + math.log((len(texts) + 1) / (sum(s in o for o in counts) + 1))) for s, c in terms.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for s in range(1024):
            assert got[str(n)][s] == pytest.approx(weights.get(s, 0.0) / norm, abs=1e-6)


DOCS = [("knowledge/ppe.md", "Hard hats are required in zone A at all times"),
        ("knowledge/food.md", "The canteen serves soup and bread at noon"),
        ("private/x.md", "Hard hats secret")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCS, "key string, text string").withColumns(
        {"uri": F.concat(F.lit("s3://docs/"), "key"), "version": F.lit(1)})


def changed(spark, key, text, version):
    return spark.createDataFrame([(key, text, f"s3://docs/{key}", version)], "key string, text string, uri string, version int")


def texts_of(spark, path):
    return {r.uri[10:]: r.text for r in read_chunks(spark, path).collect()}


def test_ingest_is_idempotent_and_replaces_changed_documents(spark, tmp_path, documents):
    path = str(tmp_path / "index")
    ingestion.create_index(ingestion.chunk_documents(documents), path)
    run = lambda docs: tuple(ingestion.ingest_knowledge(docs, path, ingestion.load_embedder(spark, path)).first())
    assert run(documents) == (2, 2, 18, "COMPLETE")
    assert run(documents) == (0, 0, 0, "COMPLETE") and read_chunks(spark, path).count() == 2
    food = "knowledge/food.md"
    assert run(changed(spark, food, "Now closed", 3)) == (1, 1, 2, "COMPLETE") and texts_of(spark, path)[food] == "Now closed"
    assert run(changed(spark, food, "An older text", 2)) == (0, 0, 0, "COMPLETE")  # late, and superseded
    assert run(changed(spark, food, "Now closed", 5)) == (0, 0, 0, "COMPLETE")  # newer, says the same
    assert run(changed(spark, food, "An older text", 4)) == (0, 0, 0, "COMPLETE") and texts_of(spark, path)[food] == "Now closed"
    assert run(changed(spark, food, dict(DOCS)[food], 6))[0] == 1 and texts_of(spark, path)[food] == dict(DOCS)[food]
    assert run(changed(spark, food, " ", 7)) == (1, 0, 0, "COMPLETE") and set(texts_of(spark, path)) == {"knowledge/ppe.md"}
    assert all(len(r.embedding) == 1024 and max(r.embedding) > 0 for r in read_chunks(spark, path).collect())


def test_an_index_without_embedder_is_refused(spark, tmp_path):
    with pytest.raises(Exception):
        ingestion.load_embedder(spark, str(tmp_path / "none"))


def test_only_missing_chunks_are_embedded(spark, tmp_path, documents):
    path = str(tmp_path / "index")
    seen = spark.sparkContext.accumulator(0)

    def embedder(chunks):
        def run(batches):
            for batch in batches:
                seen.add(int((batch["ordinal"] >= 0).sum()))
                yield batch.assign(embedding=[[1.0, 0.0]] * len(batch))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
        return chunks.mapInPandas(run, f"{fields}, embedding array<float>")

    ingestion.ingest_knowledge(documents, path, embedder)
    assert seen.value == 2
    ingestion.ingest_knowledge(documents, path, embedder, prefix="")
    assert seen.value == 3


def test_retrieval_cites_the_right_document(spark, tmp_path, documents):
    path = str(tmp_path / "index")
    embedder = ingestion.create_index(ingestion.chunk_documents(documents), path)
    ingestion.ingest_knowledge(documents, path, embedder, prefix="")
    stored = read_chunks(spark, path)
    asked = spark.createDataFrame([(1, "which zone requires hard hats", 1), (2, "soup at noon", 99), (3, " \n", 1)],
                                  "request_id long, query string, requested int")
    citations, rejected = retrieval.retrieve_knowledge(asked, stored, embedder)
    rows = citations.orderBy("request_id", "rank").collect()
    assert [r.request_id for r in rows] == [1, 2, 2, 2]
    assert rows[1].source == "s3://docs/knowledge/food.md" and rows[1].excerpt.startswith("The canteen")
    assert all(0 < r.score <= 1 for r in rows) and rows[1].score >= rows[2].score
    assert [r.request_id for r in rejected.collect()] == [3]


def test_retrieval_equals_brute_force(spark, tmp_path):
    import numpy as np

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks = ingestion.chunk_documents(table.select(F.col("doc_id").cast("string").alias("uri"), "text"))
    embedder = ingestion.fit_embedder(chunks)
    stored = ingestion.embed_chunks(chunks, embedder)
    asked = table.select(F.col("doc_id").alias("request_id"), F.col("text").alias("query"))
    citations, _ = retrieval.retrieve_knowledge(asked, stored, embedder, k=3)
    got = {}
    for r in citations.collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.chunk_id, r.distance))
    ids, vectors = zip(*sorted((r.chunk_id, r.embedding) for r in stored.collect()))
    matrix = np.array(vectors)
    queries = ingestion.embed_chunks(asked.withColumnRenamed("query", "text"), embedder)
    for r in queries.select("request_id", "embedding").collect():
        d = np.sqrt(((matrix - np.array(r.embedding)) ** 2).sum(axis=1))
        best = np.lexsort((np.arange(len(ids)), d))[:3]
        assert [(i, pytest.approx(x, abs=2e-6)) for _, i, x in sorted(got[r.request_id])] == [(ids[b], d[b]) for b in best]


def test_citation_fallbacks(spark):
    hits = spark.createDataFrame([("s3://a", "S3", "x" * 600), ("", "WEB", "y"), (None, None, None)],
                                 "uri string, location_type string, content string")
    assert [(r.source, len(r.excerpt)) for r in retrieval.shape_citations(hits).collect()] == [
        ("s3://a", 500), ("WEB", 1), ("knowledge-base", 0)]


def test_letters_are_counted_in_one_pass(monkeypatch):
    """Over the borders of the pieces a task counts, in sliced batches, beside letters of other alphabets."""
    import pyarrow as pa

    from groundwire.functions import text

    texts = ["", "abcab", "zé" * 50, "ﬀ à ß", "", "hello there" * 9, "x"]
    monkeypatch.setattr(text, "LETTER_BYTES", 16)
    got = text.count_letters(pa.array(["skipped", *texts]).slice(1))
    assert got.tolist() == [[t.count(c) for c in text.LETTERS] for t in texts]


ODD = ["", None, " lead and  trail ", "tab\tnew\nline\x0bx\x1cy\x85z\xa0end", "ÀÉ straße ΑΣ 日本語テキスト 😀b", "abcdefghijklm " * 400, "one"]


def test_terms_hash_as_in_spark_ml():
    import pyarrow as pa

    from groundwire.functions.terms import hash_terms

    terms = ["", "a", "ab", "abc", "abcd", "abcde", "żółw", "日本語テキスト", "😀b", "x" * 37]
    for dim in (1024, 1000):
        slot = HashingTF(numFeatures=dim).indexOf
        hashed = hash_terms(pa.array(["skipped", *terms], pa.large_string())[1:])
        assert (hashed % dim).tolist() == [slot(t) for t in terms]
    assert hash_terms(pa.array([], pa.large_string())).tolist() == []


def test_batches_give_the_vectors_of_the_stages(spark):
    """Without the stages, whose functions take a row at a time; a model of other stages is applied as it is."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    chunks = spark.createDataFrame([(str(n), t) for n, t in enumerate(ODD)], "chunk_id string, text string")
    model = ingestion.fit_embedder(chunks)
    fast = ingestion.embed_chunks(chunks, model)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDF(" not in plan.replace("unit(", "")
    staged = model.transform(chunks).select("chunk_id", vector_to_array("_unit", "float32").alias("embedding"))
    other = ingestion.embed_chunks(chunks, PipelineModel(model.stages[:3] + [model.stages[3].copy({model.stages[3].p: 1.0})]))
    got, want, third = ({r.chunk_id: r.embedding for r in df.collect()} for df in (fast, staged, other))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    assert all(sum(third[k]) == pytest.approx(1.0, abs=1e-5) for k in third)


def test_words_are_cut_at_every_whitespace_and_no_other(spark):
    from groundwire.functions.text import WHITESPACE_CHARS, words

    texts = [*ODD, WHITESPACE_CHARS, WHITESPACE_CHARS.join("abcdefgh"), "a\u180eb\u200bc\ufeffd\u0000e", "x\u2007y"]
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "uri string, text string")
    got = {r.uri: r.text for r in ingestion.chunk_documents(df, 500).filter("ordinal = 0").collect()}
    want = {r.uri: " ".join(r.w) for r in df.select("uri", words(F.coalesce("text", F.lit(""))).alias("w")).collect() if r.w}
    assert got == want
    broken = df.limit(1).select("uri", F.expr("cast(x'61ff2062' as string)").alias("text"))
    assert [r.n_tokens for r in ingestion.chunk_documents(broken).collect()] == [2]
