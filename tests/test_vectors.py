"""Vector search against brute force, with ties, copies, text ids and every path."""

import numpy as np
import pytest

from groundwire.operators import vectors


def brute_force(queries, rows, ks):
    out = {}
    ids = sorted(rows)
    matrix = np.array([rows[i] for i in ids], dtype=np.float32).astype(np.float64)
    for q, v in queries.items():
        d = np.sqrt(((matrix - np.array(v, dtype=np.float32).astype(np.float64)) ** 2).sum(axis=1))
        best = sorted(zip(d, ids))[: ks[q]]
        out[q] = [(n + 1, i, round(float(dist), 6)) for n, (dist, i) in enumerate(best)]
    return out


def run(spark, queries, rows, ks=None, search=vectors.vector_topk, **kw):
    kind = "string" if isinstance(next(iter(rows)), str) else "long"
    q = spark.createDataFrame([(k, v, (ks or {}).get(k)) for k, v in queries.items()], "query_id long, embedding array<float>, requested int")
    c = spark.createDataFrame(list(rows.items()), f"chunk_id {kind}, embedding array<float>").repartition(5)
    got = {}
    for r in search(q, c, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.distance))
    return {k: sorted(v) for k, v in got.items()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8)) * 5
    rows = {n: (centers[n % 6] + rng.normal(size=8)).tolist() for n in range(240)}
    # A third of the corpus and of the queries are copies of one vector.
    hot = centers[0].tolist()
    rows.update({1000 + n: hot for n in range(120)})
    queries = {n: (centers[n % 6] + rng.normal(size=8)).tolist() for n in range(40)}
    queries.update({500 + n: hot for n in range(20)})
    return queries, rows


@pytest.mark.parametrize("options", [
    {}, {"pivots": 8, "block_rows": 16}, {"pivots": 1, "block_rows": 10_000},
])
def test_exact_equals_brute_force(spark, data, options):
    queries, rows = data
    ks = {q: (0, -3, 3, 10, 99)[q % 5] for q in queries}
    effective = {q: {0: 5, -3: 1, 3: 3, 10: 10, 99: 10}[k] for q, k in ks.items()}
    assert run(spark, queries, rows, ks, **options) == brute_force(queries, rows, effective)


def test_text_ids_and_tiny_corpus(spark):
    rows = {"b": [1.0, 0.0], "a": [1.0, 0.0], "c": [0.0, 1.0]}
    queries = {1: [1.0, 0.0], 2: [0.0, 2.0]}
    got = run(spark, queries, rows, pivots=2)
    assert got == brute_force(queries, rows, {1: 5, 2: 5})
    assert [i for _, i, _ in got[1]] == ["a", "b", "c"]


def test_cells_that_cannot_hold_a_result_are_skipped(spark, data):
    queries, rows = data
    c = spark.createDataFrame([(k, v) for k, v in rows.items()], "chunk_id long, embedding array<float>")
    cells = vectors.CellIndex.build(c, pivots=12, block_rows=1000)
    wanted = vectors._probed_cells(np.array(list(queries.values()), dtype=np.float32), cells.as_arrays(), None)
    assert wanted.any(axis=1).all() and wanted.mean() < 0.9


def test_approximate_recall_grows_with_probes(spark, data):
    queries, rows = data
    q = spark.createDataFrame([(k, v) for k, v in queries.items()], "query_id long, embedding array<float>")
    c = spark.createDataFrame(list(rows.items()), "chunk_id long, embedding array<float>")
    exact = vectors.vector_topk(q, c)
    recall = [
        vectors.recall_at_k(vectors.vector_topk_ann(q, c, probes=p, pivots=8), exact).first().recall for p in (1, 8)
    ]
    assert 0.3 < recall[0] <= recall[1] == 1.0


def test_chosen_probes_reach_the_wanted_recall_on_a_stored_index(spark, data, tmp_path):
    queries, rows = data
    q = spark.createDataFrame([(k, v) for k, v in queries.items()], "query_id long, embedding array<float>")
    c = spark.createDataFrame(list(rows.items()), "chunk_id long, embedding array<float>")
    vectors.CellIndex.build(c, str(tmp_path / "cells"), pivots=24)
    cells = vectors.CellIndex.open(spark, str(tmp_path / "cells"))
    exact = vectors.vector_topk(q, cells)
    few, many = (vectors.choose_probes(q, cells, recall=r) for r in (0.5, 0.95))
    assert few <= many < 24
    assert vectors.recall_at_k(vectors.vector_topk_ann(q, cells), exact).first().recall >= 0.95


def test_one_plan_for_any_number_of_queries(spark):
    rng = np.random.default_rng(2)
    rows = {n: rng.normal(size=4).tolist() for n in range(60)}
    queries = {n: rng.normal(size=4).tolist() for n in range(4200)}
    got = run(spark, queries, rows)
    assert got == brute_force(queries, rows, dict.fromkeys(queries, 5))
    assert {k: got[k] for k in range(10)} == run(spark, {k: queries[k] for k in range(10)}, rows)


def test_many_equal_distances(spark):
    rows = {n: [float(n % 2), float((n + 1) % 2), 0.0] for n in range(3000)}
    queries = {1: [0.0, 0.0, 1.0]}
    assert run(spark, queries, rows) == brute_force(queries, rows, {1: 5})


def test_large_norms_keep_exact_order():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(500, 32)) + 1000).astype(np.float32)
    queries = (rng.normal(size=(20, 32)) + 1000).astype(np.float32)
    q_at, found, _ = vectors.closest(queries, rows, np.arange(500), 5)
    for q in range(20):
        d = ((rows.astype(float) - queries[q].astype(float)) ** 2).sum(axis=1)
        assert found[q_at == q].tolist() == np.lexsort((np.arange(500), d))[:5].tolist()


def test_queries_travel_once_to_a_load_and_bring_little_back(spark):
    """Evenly spread vectors leave no cell out: 16 cells in blocks of 20 gave each query ten rows from each of 100 blocks."""
    rng = np.random.default_rng(13)
    rows = {n: rng.normal(size=24).tolist() for n in range(2000)}
    c = spark.createDataFrame(list(rows.items()), "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(n, rows[n]) for n in range(300)], "query_id long, embedding array<float>")
    cells = vectors.CellIndex.build(c, pivots=16, block_rows=20)
    met = vectors._join_loads(vectors._asked(q, 5).drop("k"), cells, None).groupBy("query_id").count().toPandas()
    assert len(met) == 300 and met["count"].min() >= 10 and met["count"].max() <= 30
    got = {}
    for r in vectors.vector_topk(q, cells).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.distance))
    assert {k: sorted(v) for k, v in got.items()} == brute_force({n: rows[n] for n in range(300)}, rows, dict.fromkeys(range(300), 5))


def test_a_load_gives_the_closest_within_the_bound():
    rng = np.random.default_rng(17)
    rows, queries = (rng.integers(0, 3, (n, 5)).astype("f4") for n in (900, 50))
    ids, slots = rng.permutation(900), rng.integers(0, 6, 900)
    visits = rng.random((50, 8)) < 0.6
    bound = np.where(np.arange(50) % 3 == 0, np.inf, rng.random(50) * 3)
    q_at, found, distance = vectors._nearest_of_load(queries, bound, visits, rows, ids, slots, 7, 64)
    for q in range(50):
        d = np.sqrt(np.square(rows.astype("f8") - queries[q]).sum(axis=1))
        able = np.flatnonzero(visits[q][slots] & (d <= bound[q]))
        best = able[np.lexsort((ids[able], d[able]))][:7]
        assert found[q_at == q].tolist() == ids[best].tolist() and distance[q_at == q] == pytest.approx(d[best])
