"""Job events as a stream: latest status, idempotent ingest, running totals.

Every sink writes one folder per micro-batch and overwrites it when the batch
is replayed, so at-least-once delivery has the effect of exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.operators.jobs import TERMINAL, success_rate
from mockloom.streaming.batches import run_batches
from mockloom.streaming.ingest import compact, ingest_once, late_events

__all__ = ["compact", "event_stream", "ingest_once", "late_events", "latest_status", "running_stats"]


def event_stream(spark: SparkSession, directory: str, schema, pattern: str) -> DataFrame:
    """New files of a folder; event time is cast because watermarks need a zoned timestamp."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _status_aggregates():
    at = F.struct("ts", "event_id")
    final = F.col("status").isin(*TERMINAL)
    return [
        F.min(F.when(final, F.struct(at.alias("at"), F.col("status").alias("status")))).alias("ended"),
        F.max(F.struct(at.alias("at"), F.col("status").alias("status"))).alias("latest"),
    ]


def latest_status(events: DataFrame, root: str) -> DataFrame:
    """Current status per job; the first terminal status ends a job for good.

    Each batch is reduced on its own and the batches are folded when read, so no
    job, finished or not, is held in the state of the stream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("job_id").agg(*_status_aggregates()).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    path = run_batches(events, "append", root, write)
    folded = events.sparkSession.read.parquet(path).groupBy("job_id").agg(
        F.min("ended").alias("ended"), F.max("latest").alias("latest")
    )
    return folded.select(
        "job_id", F.coalesce("ended.status", "latest.status").alias("status"), F.col("ended").isNotNull().alias("finished")
    )


def running_stats(events: DataFrame, root: str) -> DataFrame:
    """Events per status with the success rate, from the last complete result."""
    path = run_batches(events.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "complete", root)
    results = events.sparkSession.read.parquet(path)
    newest = results.agg(F.max("batch")).scalar()
    counts = results.filter(F.col("batch") == newest)
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), of("completed").alias("completed"), of("failed").alias("failed"),
        (of("running") + of("pending")).alias("active"),
    ).withColumn("success_rate", success_rate(F.col("completed"), F.col("failed")))
