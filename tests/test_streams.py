"""Streams: replays, late rows, state across batches, and the shared folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundwire.functions.text import letter_embedder
from groundwire.operators import operations as ops
from groundwire.plans import workspace
from groundwire.sources import adapters
from groundwire.sources.chunk_store import read_chunks
from groundwire.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


OBJECTS = "uri string, key string, text string, version timestamp"


def test_ingest_keeps_updates_and_late_rows_across_restarts(spark, tmp_path):
    source, index, check = (str(tmp_path / n) for n in ("in", "index", "check"))

    def arrive(*rows):
        spark.createDataFrame([(f"s3://d/{k}", k, t, at(s)) for k, t, s in rows], OBJECTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.file_stream(spark, source, spark.read.parquet(source), files=1)
        done = jobs.run_ingest(jobs.stream_ingest(stream, letter_embedder), index, check)
        stored = read_chunks(spark, index).collect()
        assert all(r.embedding is not None and max(r.embedding) > 0 for r in stored)
        return {r.uri[5:]: r.text for r in stored}, [(j.documents, j.chunks) for j in done.orderBy("job").collect()]

    arrive(("knowledge/a", "one two", 0), ("private/x", "no", 1), ("knowledge/a", "one two", 5))
    assert run() == ({"d/knowledge/a": "one two"}, [(2, 2)])
    arrive(("knowledge/a", "one two", 60), ("knowledge/b", "three", 61))
    arrive(("knowledge/a", "changed", 300), ("knowledge/c", "late by a day", -86_400), ("knowledge/b", "old", -5))
    arrive(("knowledge/a", "one two", 0))
    expected = {"d/knowledge/a": "changed", "d/knowledge/b": "three", "d/knowledge/c": "late by a day"}
    stored, done = run()
    assert stored == expected and len(done) == 3
    assert run()[0] == expected
    arrive(("knowledge/b", "", 900))
    assert run()[0] == {k: t for k, t in expected.items() if not k.endswith("b")}


def test_every_batch_is_in_the_ledger(spark, tmp_path):
    """More batches than a progress report keeps, over two runs."""
    source, index, check = (str(tmp_path / n) for n in ("in", "index", "check"))

    def run(first, last):
        for n in range(first, last):
            rows = [(f"s3://d/{n}-{k}", "knowledge/x", "one two three", at(n)) for k in range(1 + n % 3)]
            spark.createDataFrame(rows, OBJECTS).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.read.parquet(source), files=1)
        return jobs.run_ingest(jobs.stream_ingest(stream), index, check).collect()

    assert jobs.ingest_ledger(spark, index) is None
    assert len(run(0, 104)) == 104 and len(run(104, 106)) == 2
    ledger = jobs.ingest_ledger(spark, index).orderBy("job").collect()
    assert [r.job for r in ledger] == list(range(1, 107)) and len({r.started for r in ledger}) == 106
    assert sorted(r.documents for r in ledger) == sorted(1 + n % 3 for n in range(106))
    assert all(r.chunks == r.documents and r.tokens == 3 * r.documents for r in ledger)


def test_scan_covers_new_files_only(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "bucket string, object_id string, text string"

    def run():
        stream = jobs.file_stream(spark, source, spark.read.parquet(source))
        jobs.run_to_parquet(jobs.stream_pii_scan(stream), "scan", sink, check)
        return sorted(r.object_id for r in spark.read.parquet(sink).collect())

    for day, expected in (("1", ["1"]), ("2", ["1", "2"])):
        spark.createDataFrame([("documents", day, f"x{day}@y.org")], schema).write.mode("append").parquet(source)
        assert run() == expected
        assert run() == expected


def windows(spark, path, batches):
    for batch in batches:
        rows = [(a, at(n * 300), float(v)) for a, n, v in batch]
        spark.createDataFrame(rows, "alarm string, period timestamp, value double").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_alarm_edges_do_not_depend_on_file_order(spark, tmp_path, order):
    series = [("p", 0, 9), ("p", 1, 9), ("p", 2, 1), ("p", 3, 9), ("p", 5, 9), ("p", 6, 9), ("p", 7, 9), ("p", 9, 0), ("q", 4, 9), ("q", 5, 9)]
    path = str(tmp_path / "w")
    parts = [series[:4], series[4:6], series[6:]]
    windows(spark, path, [parts[n] for n in order])
    stored = spark.read.parquet(path)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 300
    got = {(r.alarm, r.period_index - base, r.state, r.run) for r in ops.alarm_edges(stored, 300, 5, 2).collect()}
    assert got == {("p", 1, "ALARM", 2), ("p", 2, "OK", 2), ("p", 6, "ALARM", 2), ("p", 8, "OK", 3), ("q", 5, "ALARM", 2)}
    spans = {(r.alarm, (int(r.alarm_from.replace(tzinfo=dt.timezone.utc).timestamp()) // 300) - base) for r in ops.alarm_periods(stored, 300, 5, 2).collect()}
    assert spans == {(a, n) for a, n, s, _ in got if s == "ALARM"}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_edges_are_appended_as_a_stream(spark, tmp_path, order):
    """The same edges for every order of files, one file a batch and a restart after each, as from the table."""
    series = [("p", 0, 9), ("p", 1, 9), ("p", 2, 1), ("p", 3, 9), ("p", 5, 9), ("p", 6, 9), ("p", 7, 9), ("p", 9, 0), ("q", 4, 9), ("q", 5, 9), ("q", 5, 1)]
    path, sink, check = (str(tmp_path / n) for n in ("w", "edges", "check"))
    parts = [series[:4], series[4:6], series[6:]]
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 300

    def run(lateness="1 hour"):
        stream = jobs.file_stream(spark, path, spark.read.parquet(path), files=1)
        jobs.run_to_parquet(jobs.stream_alarm_edges(stream, 300, 5, 2, lateness), "edges", sink, check)
        return sorted((r.alarm, r.period_index - base, r.state, r.run) for r in spark.read.parquet(sink).collect())

    for n in order:
        windows(spark, path, [parts[n]])
        assert run() == []  # none has been passed by the watermark yet
    windows(spark, path, [[("z", 40, 0)]])
    first = [("p", 1, "ALARM", 2), ("p", 2, "OK", 2), ("p", 6, "ALARM", 2), ("p", 8, "OK", 3), ("q", 5, "ALARM", 2)]
    assert run() == first
    windows(spark, path, [[("q", 41, 9), ("q", 42, 9)], [("z", 90, 0)]])
    later = sorted([*first, ("q", 6, "OK", 2), ("q", 42, "ALARM", 2)])
    assert run() == later == run()
    whole = ops.alarm_edges(spark.read.parquet(path).groupBy("alarm", "period").agg(F.max("value").alias("value")), 300, 5, 2)
    assert sorted((r.alarm, r.period_index - base, r.state, r.run) for r in whole.collect()) == later


def test_counts_survive_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for half in (0, 1):
        turns.filter(F.col("conv_id") % 2 == half).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, turns, files=1)
        jobs.run_to_parquet(jobs.tier_counts(jobs.stream_route(adapters.requests_of(stream))), "tiers", sink, check)
    batch = jobs.running_tier_counts(jobs.stream_route(adapters.requests_of(turns)))
    assert sorted(map(tuple, jobs.stored_tier_counts(spark, sink).collect())) == sorted(map(tuple, batch.collect()))


def test_runs_join_across_blocks(spark):
    first = ops.RUN_BLOCK * 3 - 2
    zero = dt.datetime(1970, 1, 1)
    rows = [("p", zero + dt.timedelta(seconds=60 * (first + n)), 1.0) for n in range(5)]
    df = spark.createDataFrame(rows, "alarm string, period timestamp, value double")
    (run,) = ops.breach_runs(df, 60, 1).collect()
    assert (run.first, run.last, run.breaching) == (first, first + 4, 5)


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "event_id long, caller string, ts timestamp, method string, path string, stage string, status long, latency_ms long"

    def run(*rows):
        made = [(n, "c", at(s), "post", "/v1/query", "", status, 10) for n, (s, status) in enumerate(rows)]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.read.parquet(path))
        jobs.run_to_parquet(jobs.stream_error_counts(stream), "errors", sink, check)
        return {r.period: r.api_5xx for r in spark.read.parquet(sink).collect()}

    assert run((0, 500), (30, 500), (90, 200)) == {}
    assert run((1200, 200)) == {at(0): 2, at(60): 0}
    assert run((10, 500), (3000, 200))[at(0)] == 2


def test_stream_route_equals_batch(spark):
    sf_dir = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stream = jobs.file_stream(spark, sf_dir, turns, "conversations.parquet")
    sink = jobs.run_to_parquet(jobs.stream_route(adapters.requests_of(stream)), "route")
    batch = jobs.stream_route(adapters.requests_of(turns))
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(map(tuple, batch.collect()))


def test_running_counts(spark):
    sf_dir = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stream = jobs.file_stream(spark, sf_dir, turns, "conversations.parquet")
    counts = jobs.running_tier_counts(jobs.stream_route(adapters.requests_of(stream)))
    query = counts.writeStream.format("memory").queryName("tiers").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = jobs.running_tier_counts(jobs.stream_route(adapters.requests_of(turns)))
    assert sorted(map(tuple, spark.table("tiers").collect())) == sorted(map(tuple, batch.collect()))


class FakeSession:
    """Just the settings and the master, to try clusters this machine is not."""

    def __init__(self, master, setting=None):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("S", (), {"get": lambda _, key, default: setting})()


def test_shared_folder_comes_from_the_session(spark):
    assert workspace.shared_root(FakeSession("spark://x", "hdfs://shared/run/")) == "hdfs://shared/run"
    with pytest.raises(ValueError):
        workspace.shared_root(FakeSession("spark://x"))
    local = workspace.shared_root(FakeSession("local[2]"))
    assert local == workspace.shared_root(FakeSession("local[2]"))
    df = workspace.materialize(spark.range(5), "five")
    assert df.count() == 5 and all(workspace.shared_root(spark) in f for f in df.inputFiles())
