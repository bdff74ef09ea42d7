"""Model calls over a batch of payloads that can be stopped at any point and run again without paying a call twice.

A ledger folder holds the outcomes. Equal payloads are one call. A task writes a note of each outcome to the shared folder
before it goes on, so a task that is repeated, or a run that follows a dead one, takes up where the calls ended; when the
outcomes of all tasks stand in the ledger, the notes go. A call can only be paid again if its worker died between the
answer and the note. One run at a time writes to a ledger, and the session must not speculate: two attempts of a task that
run side by side both call.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.plans.skew import spread_join
from groundwire.plans.workspace import folder_exists, new_folder, remove_folder, scratch

KEY = "payload_key"
#: ``passing`` marks an error that may go away: its payload is called again by the next run.
OUTCOME = f"{KEY} string, output string, error string, passing boolean, attempts int, finished_at double"
_ARROW = pa.schema([
    (KEY, pa.string()), ("output", pa.string()), ("error", pa.string()), ("passing", pa.bool_()),
    ("attempts", pa.int32()), ("finished_at", pa.float64()),
])
# Fixed value: attempts of one call.
ATTEMPTS = 5

Client = Callable[[str], str]


def payload_key(payload: Column) -> Column:
    """What makes two calls the same call. A null payload has no key and is never called."""
    return F.sha2(payload, 256)


def may_pass(error: Exception) -> bool:
    """Timeouts and broken connections are worth another try; other errors come again."""
    return isinstance(error, (TimeoutError, ConnectionError))


def call_with_retries(
    client: Client, payload: str, *, attempts: int, first_wait: float, longest_wait: float,
    passing: Callable[[Exception], bool] = may_pass, sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """The outcome of one call. The wait before try n + 1 is drawn below first_wait * 2**n, so that tasks which met the
    same outage don't come back together."""
    for n in range(attempts):
        try:
            return {"output": client(payload), "error": None, "passing": False, "attempts": n + 1}
        except Exception as error:  # an outcome like any other: it becomes a row
            failure, again = f"{type(error).__name__}: {error}", passing(error)
        if not again:
            break
        if n + 1 < attempts:
            sleep(random.uniform(0, min(longest_wait, first_wait * 2**n)))
    return {"output": None, "error": failure, "passing": again, "attempts": n + 1}


def _shared_files(folder: str) -> tuple[FileSystem, str]:
    """The file system of a shared folder as tasks reach it without Spark."""
    uri = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", folder))
    return FileSystem.from_uri(uri)


def _noted(files: FileSystem, folder: str) -> Iterator[list[dict]]:
    """Outcomes noted by an earlier attempt, file by file; a line cut off by the death of its writer is no outcome."""
    for found in files.get_file_info(FileSelector(folder, allow_not_found=True)):
        if found.type != FileType.File or not found.base_name.endswith(".json"):
            continue
        with files.open_input_stream(found.path) as stream:
            lines = stream.read().decode("utf-8", "replace").splitlines()
        rows = []
        for line in lines:
            try:
                rows.append(json.loads(line))
            except ValueError:
                continue
        yield rows


def noting_calls(
    batches: Iterator[pa.RecordBatch], client_of: Callable[[], Client], folder: str, note_every: int, **retries
) -> Iterator[pa.RecordBatch]:
    """Outcomes of (payload_key, payload) rows of one task, whose notes lie in ``folder``. Keeps the keys already noted
    and ``note_every`` outcomes in memory."""
    files, folder = _shared_files(folder)
    files.create_dir(folder, recursive=True)
    known = set()
    for rows in _noted(files, folder):
        fresh = [row for row in rows if row[KEY] not in known]
        known.update(row[KEY] for row in fresh)
        yield pa.RecordBatch.from_pylist(fresh, schema=_ARROW)
    client = client_of()

    def note(rows: list[dict]) -> pa.RecordBatch:
        with files.open_output_stream(f"{folder}/{rows[0][KEY]}.json") as stream:
            stream.write("".join(json.dumps(row) + "\n" for row in rows).encode())
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    waiting: list[dict] = []
    for batch in batches:
        for key, payload in zip(batch[KEY].to_pylist(), batch["payload"].to_pylist()):
            if key in known:
                continue
            waiting.append({KEY: key, **call_with_retries(client, payload, **retries), "finished_at": time.time()})
            if len(waiting) >= note_every:
                yield note(waiting)
                waiting = []
    if waiting:
        yield note(waiting)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcome that counts per payload: a settled one before a passing error, then the latest."""
    if not folder_exists(spark, f"{path}/outcomes"):
        return spark.createDataFrame([], OUTCOME)
    rows = spark.read.schema(OUTCOME).parquet(f"{path}/outcomes")
    fields = ("output", "error", "passing", "attempts", "finished_at")
    best = F.max_by(F.struct(*fields), F.struct(~F.col("passing"), F.col("finished_at")))
    return rows.groupBy(KEY).agg(best.alias("_best")).select(KEY, "_best.*")


def _fold_notes(spark: SparkSession, path: str) -> None:
    """Bring the notes of a run that died into the ledger. Dying between the two steps leaves outcomes twice, which
    readers see once."""
    notes = f"{path}/notes"
    if folder_exists(spark, notes):
        left = spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").json(notes)
        left.filter(F.col(KEY).isNotNull() & F.col("passing").isNotNull()).write.mode("append").parquet(f"{path}/outcomes")
        remove_folder(spark, notes)


def run_model(
    batch: DataFrame, path: str, make_client: Callable[[], Client], *, calls_per_task: int = 2000,
    parallel_calls: int | None = None, attempts: int = ATTEMPTS, first_wait: float = 0.5, longest_wait: float = 20.0,
    passing: Callable[[Exception], bool] = may_pass, note_every: int = 1,
) -> DataFrame:
    """Rows of ``batch`` (payload and others) without payload, with payload_key, output, error, passing and attempts.

    Calls every distinct payload whose outcome the ledger below ``path`` does not settle, in tasks of about
    ``calls_per_task``, or in ``parallel_calls`` tasks where the service bears no more. ``make_client`` is called once
    per task. A refused payload is a row with its error and is not called again; a passing error is tried again by the
    next run. ``note_every`` above one saves small files for cheap calls, and risks as many of them.
    """
    spark = batch.sparkSession
    _fold_notes(spark, path)
    keyed = batch.withColumn(KEY, payload_key(F.col("payload")))
    settled = read_outcomes(spark, path).filter(~F.col("passing")).select(KEY)
    # Distinct first: a payload that a third of the rows share is one row per task before the shuffle, and the join
    # uses the same partitioning.
    wanted = keyed.select(KEY, "payload").filter(F.col(KEY).isNotNull()).dropDuplicates([KEY])
    with scratch(wanted.join(settled, KEY, "left_anti"), "open-calls") as open_calls:
        calls = open_calls.count()
        if calls:
            tasks = ceil(calls / calls_per_task)
            # The hash of the key deals the same rows to a task whenever it is repeated.
            dealt = open_calls.repartition(min(tasks, parallel_calls or tasks), KEY)
            notes = new_folder(spark, "run", f"{path}/notes")
            retries = {"attempts": attempts, "first_wait": first_wait, "longest_wait": longest_wait, "passing": passing}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                part = TaskContext.get().partitionId()
                return noting_calls(batches, make_client, f"{notes}/{part}", note_every, **retries)

            dealt.mapInArrow(run, OUTCOME).write.mode("append").parquet(f"{path}/outcomes")
            remove_folder(spark, f"{path}/notes")
    outcomes = read_outcomes(spark, path).drop("finished_at")
    others = [c for c in batch.columns if c != "payload"]
    joined = spread_join(keyed.drop("payload"), outcomes, [KEY], [F.col(c) for c in others or [KEY]])
    return joined.select(*others, *outcomes.columns)
