"""Runs of a stream over what is available, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_batches(stream: DataFrame, mode: str, root: str, write: Callable[[DataFrame, int], None] | None = None) -> str:
    """Process what is available and return the folder of batch outputs.

    ``root`` belongs to the caller. A later run with the same folder goes on
    where the last one ended, also after a crash. ``write`` has to overwrite
    what an earlier try of the same batch has left.
    """

    def plain(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(write or plain)
        .start()
    )
    query.awaitTermination()
    return f"{root}/out"
