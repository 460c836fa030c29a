"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.llm import decontaminate, html, idfile, lines, manifest, manifest_sql, mixing, near, pii, quality, shards, simhash, spelling, spelling_sql, sql, tokens
from mockloom.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("mix.size") * F.col("mix.copies")).cast("long").alias("taken")
    return mixed.select("doc.doc_id", "mix.size", "mix.source_size", "mix.target", taken)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_id_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    idfile.write_ids(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return idfile.digest(idfile.read_ids(spark, path))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", manifest.digest(*fields, F.col("text")).alias("leaf"), manifest.digest(*fields, tampered).alias("shown"))
    made = manifest.manifest(leaves)
    folded = manifest.fold(F.col("row.shown"), F.col("witness"))
    out = made.select("row.doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("witness")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3).select("doc_id", "fingerprint", "component_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_source_mix": op6_source_mix,
    "op7_main_text": op7_main_text,
    "op8_id_file": op8_id_file,
    "op9_decontaminate": op9_decontaminate,
    "op10_shards": op10_shards,
    "op11_manifest": op11_manifest,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op3_near_dedup": sql.NEAR_DEDUP, "op4_line_dedup": sql.LINE_DEDUP, "op6_source_mix": sql.SOURCE_MIX, "op11_manifest": manifest_sql.MANIFEST, "op13_spelling": spelling_sql.SPELLING}
