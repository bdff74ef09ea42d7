"""The resumable model stage: what is paid, what is tried again, and what is left after a death."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from groundwire.operators.model_stage import KEY, call_with_retries, noting_calls, read_outcomes, run_model

cloudpickle.register_pickle_by_value(sys.modules[__name__])
QUICK = {"first_wait": 0.0}


def batch(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string").repartition(3)


def counting(log, fail=lambda payload: None):
    """A client that writes down every call it is paid for."""
    def make():
        def call(payload):
            fail(payload)
            with open(log, "a") as out:
                out.write(payload + "\n")
            return payload.upper()

        return call

    return make


def paid(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def rows(results):
    return {r.request_id: (r.output, r.error, r.attempts) for r in results.collect()}


def test_equal_payloads_are_one_call_and_a_rerun_pays_none(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    asked = batch(spark, "a", "b", "a", None, "")
    results = rows(run_model(asked, ledger, counting(log), **QUICK))
    assert results == {0: ("A", None, 1), 1: ("B", None, 1), 2: ("A", None, 1), 3: (None, None, None), 4: ("", None, 1)}
    assert rows(run_model(asked, ledger, counting(log), **QUICK)) == results
    assert paid(log) == ["a", "b"]  # and the empty one, which leaves an empty line
    assert rows(run_model(batch(spark, "b", "c"), ledger, counting(log), **QUICK)) == {0: ("B", None, 1), 1: ("C", None, 1)}
    assert paid(log) == ["a", "b", "c"]


def test_passing_errors_are_tried_again_and_refusals_are_not(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")

    def outage(payload):
        if payload == "late":
            raise TimeoutError("busy")
        if payload == "bad":
            raise ValueError("refused")

    def healthy(payload):
        assert payload != "bad"

    asked = batch(spark, "good", "late", "bad")
    first = rows(run_model(asked, ledger, counting(log, outage), **QUICK))
    assert first == {0: ("GOOD", None, 1), 1: (None, "TimeoutError: busy", 5), 2: (None, "ValueError: refused", 1)}
    second = rows(run_model(asked, ledger, counting(log, healthy), **QUICK))
    assert second == {**first, 1: ("LATE", None, 1)}
    assert paid(log) == ["good", "late"]


def test_a_run_that_dies_half_way_leaves_its_answers(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    words = [f"w{n:03}" for n in range(60)]

    def die(payload):
        if len(paid(log)) >= 25:
            os._exit(1)

    asked = batch(spark, *words)
    with pytest.raises(Exception):
        run_model(asked, ledger, counting(log, die), parallel_calls=1, **QUICK)
    before = paid(log)
    assert len(before) == 25
    results = rows(run_model(asked, ledger, counting(log), parallel_calls=4, **QUICK))
    assert results == {n: (w.upper(), None, 1) for n, w in enumerate(words)}
    assert paid(log) == words  # each once, over both runs
    assert not os.path.exists(f"{ledger}/notes")


@pytest.mark.parametrize("note_every", [1, 4])
def test_a_repeated_task_goes_on_after_its_notes(tmp_path, note_every):
    import pyarrow as pa

    log, notes = str(tmp_path / "log"), f"file:{tmp_path}/notes"
    task = [pa.RecordBatch.from_pylist([{KEY: w, "payload": w} for w in "abcdefghij"])]
    retries = {"attempts": 1, "first_wait": 0.0, "longest_wait": 0.0}

    def broken(payload):
        if payload == "h":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        list(noting_calls(iter(task), counting(log, broken), notes, note_every, **retries))
    (tmp_path / "notes" / "cut.json").write_text('{"payload_key": "i", "outp')  # its writer died
    again = list(noting_calls(iter(task), counting(log), notes, note_every, **retries))
    assert sorted(r[KEY] for b in again for r in b.to_pylist()) == list("abcdefghij")
    twice = {w for w in paid(log) if paid(log).count(w) > 1}
    assert twice == (set() if note_every == 1 else set("efg"))  # what was not yet noted


def test_waits_grow_and_stay_below_their_bound(monkeypatch):
    waits = []
    monkeypatch.setattr("random.uniform", lambda low, high: high)

    def busy(payload):
        raise ConnectionError("busy")

    outcome = call_with_retries(busy, "x", attempts=5, first_wait=1.0, longest_wait=3.0, sleep=waits.append)
    assert waits == [1.0, 2.0, 3.0, 3.0]
    assert (outcome["passing"], outcome["attempts"], outcome["output"]) == (True, 5, None)


def test_tables_without_rows(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    results = run_model(batch(spark, "a").filter(F.lit(False)), ledger, counting(str(tmp_path / "log")), **QUICK)
    assert results.columns == ["request_id", KEY, "output", "error", "passing", "attempts"] and results.count() == 0
    assert read_outcomes(spark, ledger).count() == 0


def test_one_payload_of_most_rows_is_one_call(spark, tmp_path):
    log = str(tmp_path / "log")
    asked = spark.range(3000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("payload"))
    results = run_model(asked, str(tmp_path / "ledger"), counting(log), calls_per_task=300, note_every=50, **QUICK)
    assert results.filter("output = 'SAME'").count() == 2000 and results.count() == 3000
    assert paid(log).count("same") == 1 and len(paid(log)) == 1001


def test_notes_are_plain_lines(tmp_path):
    import pyarrow as pa

    task = [pa.RecordBatch.from_pylist([{KEY: "k", "payload": "line\nbreak  "}])]
    list(noting_calls(iter(task), counting(str(tmp_path / "log")), str(tmp_path / "notes"), 1, attempts=1, first_wait=0.0, longest_wait=0.0))
    [line] = (tmp_path / "notes" / "k.json").read_text().splitlines()
    assert json.loads(line)["output"] == "LINE\nBREAK  "
