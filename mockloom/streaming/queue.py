"""A queue of jobs that are acknowledged after their work: each payload is a file, waiting until its outcome is written.

    <queue>/waiting/<message>.json     payloads not settled yet
    <queue>/settled/<message>.json     payloads with a final outcome
    <root>/outcome/_batch=N/status=..  what became of each message in round N
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mockloom.streaming.batches import run_batches
from mockloom.streaming.ingest import complete

#: Messages that one task reads.
PER_TASK = 256
MESSAGE = "message string, payload string"
OUTCOME = "message string, attempt int, status string, result string, error string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, on any store that the workers reach."""
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceStreamReader):
    """An offset is a number of finished rounds; a round delivers every message still waiting.

    Both come from the folders, not from memory: after a crash the round is
    planned anew from what is still waiting, and a message leaves the queue
    only after its outcome was written.
    """

    def __init__(self, options):
        self.queue, self.root = options["path"], options["root"]

    def _waiting(self) -> list[str]:
        store, path = _open(self.queue)
        found = store.get_file_info(fs.FileSelector(f"{path}/waiting", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and f.base_name[0] not in "._")

    def _rounds(self) -> int:
        store, path = _open(self.root)
        folders = store.get_file_info(fs.FileSelector(f"{path}/outcome", allow_not_found=True))
        ended = store.get_file_info([f"{f.path}/_SUCCESS" for f in folders])
        return sum(f.is_file for f in ended)

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": self._rounds() + bool(self._waiting())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = self._waiting() if start != end else []
        return [_Names(names[i:i + PER_TASK]) for i in range(0, len(names), PER_TASK)]

    def read(self, partition: _Names) -> Iterator[tuple]:
        store, path = _open(self.queue)
        for name in partition.names:
            with store.open_input_stream(f"{path}/waiting/{name}") as f:
                yield name.removesuffix(".json"), f.read().decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Nothing is left to do: messages were settled with their outcomes."""


class JobQueue(DataSource):
    """Streaming source ``job_queue``: the messages waiting in ``path``, whose outcomes are written below ``root``."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def enqueue(jobs: DataFrame, queue: str, message: str = "job_id") -> int:
    """File one payload (JSON of the row) for each row under its ``message`` name; returns their number.

    A name that is waiting is replaced, one that is settled is left alone, so that
    a repeated call, or a task run twice, adds no second job. Names must be fit for files;
    of rows of one name one stays, and a row without a name is an error.
    """
    store, path = _open(queue)
    store.create_dir(f"{path}/waiting")
    store.create_dir(f"{path}/settled")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(queue)
        for batch in batches:
            new = 0
            for name, payload in zip(batch["message"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"not a name for a message: {name!r}")
                if store.get_file_info(f"{path}/settled/{name}.json").is_file:
                    continue
                # hidden until it is whole
                with store.open_output_stream(f"{path}/waiting/.{name}.part") as f:
                    f.write(payload.encode())
                store.move(f"{path}/waiting/.{name}.part", f"{path}/waiting/{name}.json")
                new += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([new], pa.int64())})

    named = jobs.groupBy(F.col(message).cast("string").alias("message")).agg(F.min(F.to_json(F.struct(*jobs.columns))).alias("payload"))
    return named.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _settle(messages: DataFrame, queue: str) -> None:
    """Take messages out of the queue; one that was taken out before is passed over."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(queue)
        for batch in batches:
            for name in batch["message"].to_pylist():
                if store.get_file_info(f"{path}/waiting/{name}.json").is_file:
                    store.move(f"{path}/waiting/{name}.json", f"{path}/settled/{name}.json")
            yield batch

    messages.select("message").mapInArrow(move, "message string").write.format("noop").mode("overwrite").save()


def work_off(spark: SparkSession, queue: str, root: str, handler: Callable[[dict], object], attempts: int = 3) -> DataFrame:
    """One round: run ``handler`` once on each waiting payload, then acknowledge what came to an end.

    A job whose handler returns is ``done`` with its result as JSON. One whose handler
    raises is ``failed``: it stays in the queue, unacknowledged, for the next round, and after
    ``attempts`` rounds is set aside as ``dead``; a payload that is no JSON object likewise. Outcomes
    are written before anything is acknowledged, and a replayed round with outcomes only acknowledges:
    each outcome counts once, while a handler may run again after a crash. One round
    runs at a time. Returns the ``outcomes`` so far.
    """
    spark.dataSource.register(JobQueue)
    waiting = spark.readStream.format("job_queue").option("root", root).load(queue)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"message": [], "attempt": [], "status": [], "result": [], "error": []}
            for name, payload, before in zip(*(batch[c].to_pylist() for c in ("message", "payload", "before")), strict=True):
                result = error = None
                try:
                    job = json.loads(payload)
                    if not isinstance(job, dict):
                        raise ValueError("the payload is no JSON object")
                    result = json.dumps(handler(job))
                    status = "done"
                except Exception as e:  # whatever a job raises is its own outcome, never the stream's
                    error = f"{type(e).__name__}: {e}"
                    status = "failed" if before + 1 < attempts else "dead"
                for key, value in zip(out, (name, before + 1, status, result, error), strict=True):
                    out[key].append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        finished = complete(spark, f"{root}/outcome", "_batch")
        if batch_id not in finished:
            # every unsettled message is in each round, so the round before knows all attempts
            last = [n for n in finished if n < batch_id][-1:]
            before = _outcomes(spark, root, last).filter("status = 'failed'").select("message", F.col("attempt").alias("before"))
            todo = batch.join(before, "message", "left").withColumn("before", F.coalesce("before", F.lit(0)))
            todo.mapInArrow(tried, OUTCOME).write.mode("overwrite").partitionBy("status").parquet(f"{root}/outcome/_batch={batch_id}")
        _settle(_outcomes(spark, root, [batch_id]).filter("status <> 'failed'"), queue)

    run_batches(waiting, "append", root, write)
    return outcomes(spark, root)


def _outcomes(spark: SparkSession, root: str, rounds: list[int]) -> DataFrame:
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    if not rounds:
        return spark.createDataFrame([], OUTCOME)
    files = spark.read.schema(OUTCOME).option("basePath", f"{root}/outcome").parquet(*[f"{root}/outcome/_batch={n}" for n in rounds])
    return files.select(*names)


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Newest outcome of every message: message, attempt, status (done, failed, dead), result, error."""
    rounds = complete(spark, f"{root}/outcome", "_batch")
    found = _outcomes(spark, root, rounds)
    rest = ["attempt", "status", "result", "error"]
    return found.groupBy("message").agg(F.max(F.struct(*rest)).alias("_last")).select("message", "_last.*")
