"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mockloom.session import scratch_path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The table as Parquet in the shared folder, reread: no lineage, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
