"""Training-data pipeline over ``documents``: each stage's output is written as Parquet and reread as the next one's input.

Rejected documents go, one of each near-duplicate group stays, documents that
hold a benchmark item go, sources are mixed to their target weights (so documents
may repeat), and what is left is written as a file of token ids. All stages but
the last return the columns of ``documents``. SQL can express neither the trees
nor the tokenizer, so there is no SQL for the whole; tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mockloom.llm import decontaminate, idfile, mixing, near, quality
from mockloom.llm.queries import END_ID, TOKENIZER
from mockloom.llm.store import written
from mockloom.session import scratch_path

#: Words of a shingle and similarity in percent from which documents are near duplicates.
SHINGLE, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on ``labels``."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.representatives(docs, n=SHINGLE, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every copy, read back from the file of token ids."""
    path = scratch_path(spark, "ids")
    idfile.write_ids(docs, path, TOKENIZER, END_ID)
    return idfile.digest(idfile.read_ids(spark, path))


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
