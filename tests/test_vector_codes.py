"""Coded vectors: recall against brute force, and exact distances of what is found."""

import numpy as np
import pytest

from groundwire.operators import vector_codes, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(1500, 32)).astype("f4")
    rows[700:740] = rows[3]  # copies
    queries = (rows[rng.integers(0, 1500, 60)] + rng.normal(scale=0.3, size=(60, 32))).astype("f4")
    q = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(f"c{n:04}", v.tolist()) for n, v in enumerate(rows)], "chunk_id string, embedding array<float>")
    return rows, queries, q, vector_codes.build_codes(vectors.CellIndex.build(c, pivots=12, block_rows=100), parts=8)


def test_codes_are_small_and_near(data):
    rows, _, _, index = data
    codes = index.book.encode(rows)
    assert codes.shape == (1500, 8) and codes.dtype == np.uint8
    error = np.square(index.book.decode(codes) - rows).sum(axis=1)
    assert error.mean() < 0.3 * np.square(rows).sum(axis=1).mean()
    assert {len(r.code) for r in index.codes.collect()} == {8}


def test_recall_and_exact_distances(data):
    rows, queries, q, index = data
    distance = np.sqrt(np.square(queries[:, None].astype("f8") - rows[None]).sum(axis=2))
    got = vector_codes.vector_topk_coded(q, index, rerank=80).collect()
    assert len(got) == 60 * 5
    for r in got:
        assert r.distance == pytest.approx(distance[r.query_id, int(r.chunk_id[1:])], abs=1e-5)
    measured = vector_codes.coded_recall(q, index, rerank=80).first()
    assert measured.expected == 300 and measured.recall >= 0.95 and measured.read_share < 0.06
    # reading everything again makes it exact
    whole = vector_codes.vector_topk_coded(q, index, rerank=1500).collect()
    assert sorted(whole) == sorted(vectors.vector_topk(q, index.cells).collect())


def test_few_vectors(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1], 99), (2, None, 1)], "query_id long, embedding array<float>, requested int")
    index = vector_codes.build_codes(vectors.CellIndex.build(c, pivots=4))
    got = vector_codes.vector_topk_coded(q, index).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(1, 1, 1), (1, 2, 2)]
    assert vector_codes.vector_topk_coded(q.limit(0), index).collect() == []


def test_codes_grow_until_the_recall_is_reached(spark):
    """Evenly spread vectors of which few are read again: 4 bytes a vector find too little of the true neighbours."""
    rows = np.random.default_rng(19).normal(size=(1200, 16)).astype("f4")
    c = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rows)], "chunk_id long, embedding array<float>")
    q = c.filter("chunk_id < 200").withColumnRenamed("chunk_id", "query_id")
    cells = vectors.CellIndex.build(c, pivots=8)
    short = vector_codes.coded_recall(q, vector_codes.build_codes(cells, parts=4), rerank=12).first()
    index = vector_codes.codes_for_recall(q, cells, rerank=12, parts=4)
    assert short.recall < 0.95 <= vector_codes.coded_recall(q, index, rerank=12).first().recall
    assert len(index.codes.first().code) > 4
