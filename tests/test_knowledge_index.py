"""The store's snapshots and its search index: the same rows and neighbours whatever was merged, split or replaced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import ingestion, knowledge_index, retrieval, vectors
from groundwire.sources import chunk_store

WORDS = [f"{a}{b}" for a in ("alp", "bra", "cho", "dun", "ekk", "fyl") for b in ("ham", "iso", "jit", "kel", "lor", "mun", "nop")]


def documents(spark, ids, version, salt=0):
    rows = [(f"s3://d/{n}", "knowledge/x", " ".join(WORDS[(n * 7 + k * (3 + salt)) % len(WORDS)] for k in range(5 + n % 9)), version) for n in ids]
    return spark.createDataFrame(rows, "uri string, key string, text string, version int")


def rows_of(spark, path):
    return sorted((r.uri, r.ordinal, r.text) for r in chunk_store.read_chunks(spark, path).collect())


def neighbours(spark, path, index):
    """Search results through an index, and by brute force over the current chunks."""
    stored = chunk_store.read_chunks(spark, path).select("chunk_id", "embedding").collect()
    ids = np.array([r.chunk_id for r in stored])
    matrix = np.array([r.embedding for r in stored], "f4").astype("f8")
    asked = matrix[::3] + 0.01
    queries = spark.createDataFrame([(n, v.tolist(), 7) for n, v in enumerate(asked)], "query_id long, embedding array<float>, requested int")
    got = {}
    for r in vectors.vector_topk(queries, index).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    want = {}
    for n, v in enumerate(asked.astype("f4").astype("f8")):
        distance = np.sqrt(((matrix - v) ** 2).sum(axis=1))
        want[n] = [(k + 1, ids[at]) for k, at in enumerate(np.lexsort((ids, distance))[:7])]
    return {q: sorted(found) for q, found in got.items()}, want


def files_read(df):
    """How many files the scans of a plan opened."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("uri")._jdf.queryExecution()
        plan.toRdd().count()
        leaves = plan.executedPlan().collectLeaves()
        scans = [leaves.apply(n) for n in range(leaves.size())]
        return sum(s.metrics().get("numFiles").get().value() for s in scans if s.metrics().contains("numFiles"))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_same_rows_before_during_and_after_a_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    for ids, version, salt in ((range(40), 1, 0), (range(20, 50), 2, 1), (range(10), 1, 5)):
        ingestion.ingest_knowledge(documents(spark, ids, version, salt), path, None)
    before = rows_of(spark, path)
    opened = chunk_store.read_chunks(spark, path)  # a reader of the time before
    appended = files_read(chunk_store.Store(spark, path).appended)
    assert chunk_store.merge_versions(spark, path) == 1 and rows_of(spark, path) == before
    assert sorted((r.uri, r.ordinal, r.text) for r in opened.collect()) == before
    # only current files are opened: none of the appended ones, and of every bucket the newest snapshot
    store = chunk_store.Store(spark, path)
    assert appended > 0 and files_read(store.appended) == 0 and files_read(store.merged) > 0
    assert chunk_store.merge_versions(spark, path) == 1  # nothing new, nothing written
    # one changed, one late, one new and one removed document: readers see them before the next merge and after it
    ingestion.ingest_knowledge(documents(spark, [3], 9, 2), path, None)
    ingestion.ingest_knowledge(documents(spark, [30], 1, 3), path, None)  # older than what is stored
    ingestion.ingest_knowledge(documents(spark, [99], None, 0), path, None)
    blank = documents(spark, [5], 9).withColumn("text", F.lit(" "))
    ingestion.ingest_knowledge(blank, path, None)
    news = rows_of(spark, path)
    assert {u for u, *_ in news} == {u for u, *_ in before} - {"s3://d/5"} | {"s3://d/99"}
    kept = chunk_store.newest_manifest(spark, path).folders
    assert chunk_store.merge_versions(spark, path) == 2 and rows_of(spark, path) == news
    now = chunk_store.newest_manifest(spark, path).folders
    assert 0 < sum(now[b] != kept.get(b) for b in now) <= 3  # other buckets stay where they are
    # what is stored counts for the next ingest, merged or not
    again = ingestion.ingest_knowledge(documents(spark, range(20, 50), 2, 1), path, None).first()
    assert (again.documents, again.chunks) == (0, 0) and rows_of(spark, path) == news


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    ingestion.ingest_knowledge(documents(spark, range(12), 1), path, None)
    before = rows_of(spark, path)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        chunk_store.merge_versions(spark, path)
    monkeypatch.undo()
    assert rows_of(spark, path) == before and chunk_store.newest_manifest(spark, path).number == 0
    assert chunk_store.merge_versions(spark, path) == 1 and rows_of(spark, path) == before


def test_a_snapshot_of_blank_documents(spark, tmp_path):
    path = str(tmp_path / "store")
    blank = documents(spark, range(3), 1).withColumn("text", F.lit(""))
    ingestion.ingest_knowledge(blank, path, None)
    assert chunk_store.merge_versions(spark, path) == 1 and chunk_store.read_chunks(spark, path).collect() == []
    ingestion.ingest_knowledge(documents(spark, [1], 2), path, None)
    assert {u for u, *_ in rows_of(spark, path)} == {"s3://d/1"}


def test_the_index_follows_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    ingestion.ingest_knowledge(documents(spark, range(120), 1), path, letter_embedder)
    assert knowledge_index.open_index(spark, path) is None
    assert knowledge_index.refresh_index(spark, path, split_rows=30) >= 1
    got, want = neighbours(spark, path, knowledge_index.open_index(spark, path, block_rows=16))
    assert got == want
    # every ingest puts its versions in: changed, new and again the first text
    for ids, version, salt in ((range(0, 60), 2, 1), (range(100, 180), 2, 2), (range(0, 20), 3, 0)):
        ingestion.ingest_knowledge(documents(spark, ids, version, salt), path, letter_embedder)
        index = knowledge_index.open_index(spark, path, block_rows=16)
        got, want = neighbours(spark, path, index)
        assert got == want
    current = {r.chunk_id for r in chunk_store.read_chunks(spark, path).collect()}
    held = [r.chunk_id for r in index.rows.collect()]
    assert len(held) == len(set(held)) and set(held) == current
    # a merge of the store changes nothing, and a refresh finds nothing to do
    parts = knowledge_index.refresh_index(spark, path)
    chunk_store.merge_versions(spark, path)
    assert knowledge_index.refresh_index(spark, path) == parts
    got, want = neighbours(spark, path, knowledge_index.open_index(spark, path))
    assert got == want


def test_large_cells_are_divided(spark, tmp_path):
    path = str(tmp_path / "store")
    ingestion.ingest_knowledge(documents(spark, range(60), 1), path, letter_embedder)
    knowledge_index.refresh_index(spark, path, split_rows=10**6)
    pivots = len(knowledge_index.open_index(spark, path).pivots)
    same = documents(spark, range(200, 320), 1).withColumn("text", F.lit("all alike"))  # one cell that can't be divided
    ingestion.ingest_knowledge(same, path, letter_embedder)
    ingestion.ingest_knowledge(documents(spark, range(400, 600), 1), path, None)  # stored without vectors
    ingestion.ingest_knowledge(documents(spark, range(700, 900), 1, 3), path, letter_embedder)
    parts = knowledge_index._Parts(spark, path)
    number = knowledge_index._split(parts, 12)
    index = knowledge_index.open_index(spark, path)
    after = knowledge_index._Parts(spark, path)
    assert number == parts.next and after.closed and len(index.pivots) > pivots
    sizes = {r.cell: r["count"] for r in index.rows.groupBy("cell").count().collect()}
    assert not set(sizes) & set(after.closed) and max(sizes.values()) >= 120
    # later ingests use open cells only
    ingestion.ingest_knowledge(documents(spark, range(30), 4, 2), path, letter_embedder)
    index = knowledge_index.open_index(spark, path)
    held = {r.cell for r in index.rows.select("cell").distinct().collect()}
    assert not held & set(after.closed)
    stored = chunk_store.read_chunks(spark, path).filter("embedding IS NOT NULL").select("chunk_id")
    assert sorted(r.chunk_id for r in stored.collect()) == sorted(r.chunk_id for r in index.rows.collect())


def test_streamed_rows_are_taken_up_by_a_refresh(spark, tmp_path):
    path = str(tmp_path / "store")
    ingestion.ingest_knowledge(documents(spark, range(30), 1), path, letter_embedder)
    knowledge_index.refresh_index(spark, path)
    late = ingestion.version_rows(documents(spark, [1, 2, 50], 3, 4), letter_embedder).unionByName(
        ingestion.version_rows(documents(spark, [3], 0, 4), letter_embedder))
    late.write.mode("append").partitionBy("bucket").parquet(f"{path}/stream")
    assert knowledge_index.refresh_index(spark, path) == 2
    got, want = neighbours(spark, path, knowledge_index.open_index(spark, path))
    assert got == want


def test_retrieval_opens_the_index(spark, tmp_path):
    path = str(tmp_path / "store")
    asked = spark.createDataFrame([(n, " ".join(WORDS[n : n + 6])) for n in range(20)], "request_id long, query string")
    with pytest.raises(ValueError, match="no search index"):
        retrieval.retrieve_from_store(asked, path, letter_embedder)
    ingestion.ingest_knowledge(documents(spark, range(80), 1), path, letter_embedder)
    knowledge_index.refresh_index(spark, path)
    ingestion.ingest_knowledge(documents(spark, range(40), 2, 3), path, letter_embedder)
    through, _ = retrieval.retrieve_from_store(asked, path, letter_embedder)
    plain, _ = retrieval.retrieve_knowledge(asked, chunk_store.read_chunks(spark, path), letter_embedder)
    columns = ["request_id", "rank", "chunk_id", "distance", "source", "excerpt"]
    assert sorted(through.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_query_blocks_keep_neighbours_together(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6)) * 8
    rows = {n: (centers[n % 12] + rng.normal(size=6)).tolist() for n in range(600)}
    queries = {n: (centers[n % 12] + rng.normal(size=6)).tolist() for n in range(500)}
    c = spark.createDataFrame(list(rows.items()), "chunk_id long, embedding array<float>")
    q = spark.createDataFrame(list(queries.items()), "query_id long, embedding array<float>")
    cells = vectors.CellIndex.build(c, pivots=12, block_rows=50)
    asked = vectors._grouped(q.withColumn("k", F.lit(5)), cells)
    visits, occur = vectors._visits(asked, cells, None)
    pairs = {(r.cell, r.query_block) for r in occur.collect()}
    assert pairs == {(r.cell, r.query_block) for r in visits.collect()}
    blocks = {b for _, b in pairs}
    assert len(blocks) >= 10 and len(pairs) < 0.75 * 12 * len(blocks)  # a row goes to the blocks that visit its cell
    assert asked.groupBy("query_block").count().agg(F.max("count")).first()[0] <= 75


def test_late_versions_leave_the_snapshot_where_it_is(spark, tmp_path):
    """What is appended and replaces nothing costs a look at its headers; what replaces moves its buckets only."""
    path = str(tmp_path / "store")
    ingestion.ingest_knowledge(documents(spark, range(80), 2), path, None)
    chunk_store.merge_versions(spark, path)
    before = rows_of(spark, path)
    chunk_store.append_rows(ingestion.version_rows(documents(spark, range(30), 1, 3), None), path)
    read = chunk_store.read_chunks(spark, path)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString() and rows_of(spark, path) == before
    chunk_store.append_rows(ingestion.version_rows(documents(spark, [7], 3, 3), None), path)
    changed = rows_of(spark, path)
    assert [r for r in changed if r[0] != "s3://d/7"] == [r for r in before if r[0] != "s3://d/7"] and changed != before
    assert chunk_store.merge_versions(spark, path) == 2 and rows_of(spark, path) == changed


def test_an_ingest_writes_its_texts_once(spark, tmp_path, monkeypatch):
    """No table of texts between; one file per bucket and share, also where versions are repeated or known."""
    from groundwire.operators import ingestion as module

    monkeypatch.setattr(module, "scratch", None)
    path = str(tmp_path / "store")
    both = documents(spark, range(50), 1, 1).unionByName(documents(spark, range(20), 2)).unionByName(documents(spark, range(20), 2))
    assert ingestion.ingest_knowledge(both, path, letter_embedder).first().documents == 50
    kept = rows_of(spark, path)
    assert len(kept) == 50 and set(rows_of(spark, path)) >= {(r.uri, 0, r.text) for r in documents(spark, range(20), 2).collect()}
    files = chunk_store.Store(spark, path).appended.select("bucket", "file").distinct().groupBy("bucket").count()
    assert {r["count"] for r in files.collect()} == {1}
    again = ingestion.ingest_knowledge(documents(spark, range(20), 5), path, letter_embedder).first()
    assert (again.documents, again.chunks, again.tokens) == (0, 0, 0) and rows_of(spark, path) == kept
    assert {r.version for r in chunk_store.Store(spark, path).versions().filter("version > 1").collect()} == {5}


def test_columns_of_vectors_are_found_where_they_lie(spark, tmp_path):
    """Only they move to the comparison of versions, not the vectors, beside a snapshot too."""
    path = str(tmp_path / "store")
    for version in (1, 2):
        ingestion.ingest_knowledge(documents(spark, range(20), version, version), path, letter_embedder)
        read = chunk_store.read_chunks(spark, path, size=F.size("embedding")).select("uri", "size")
        assert sorted((r.uri, r.size) for r in read.collect()) == sorted((f"s3://d/{n}", 26) for n in range(20))
        shuffled = read._jdf.queryExecution().executedPlan().toString()
        aggregates = [x for x in shuffled.split("\n") if "Aggregate" in x and "first" in x]
        assert aggregates and not any("embedding" in x for x in aggregates)
        chunk_store.merge_versions(spark, path)
