"""Table sets on disk: CSV and columnar reads and writes, file listings."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SYNTHETIC_SUFFIX = "_synthetic"
FORMATS = ("csv", "parquet", "json", "orc")

log = logging.getLogger(__name__)


def read_json_column(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def table_name(file_name: Column, synthetic: bool) -> Column:
    """File stem, without the suffix of synthetic files."""
    stem = F.regexp_replace(file_name, r"\.csv$", "")
    return F.replace(stem, F.lit(SYNTHETIC_SUFFIX), F.lit("")) if synthetic else stem


def read_csv_set(spark: SparkSession, directory: str, schemas: dict[str, StructType | str], synthetic: bool = False) -> dict[str, DataFrame]:
    """Named tables of a folder. Each table may be one file or a folder of part files."""
    suffix = SYNTHETIC_SUFFIX if synthetic else ""
    return {
        name: spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(f"{directory}/{name}{suffix}.csv")
        for name, schema in schemas.items()
    }


def csv_table_names(spark: SparkSession, directory: str, synthetic: bool = False) -> list[str]:
    """Names of the tables of a folder, whether files or folders of part files. Contents are not read."""
    suffix = SYNTHETIC_SUFFIX if synthetic else ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path")
    below = F.split(F.element_at(F.split("path", f"/{directory.rstrip('/').rsplit('/', 1)[-1]}/", 2), -1), "/")[0]
    names = files.select(below.alias("entry")).filter(F.col("entry").endswith(f"{suffix}.csv")).distinct()
    return sorted(r[0] for r in names.select(table_name(F.col("entry"), synthetic)).collect())  # one row per table


def load_datasets(
    spark: SparkSession, real_dir: str, synth_dir: str, schemas: dict[str, StructType | str] | None = None
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Both table sets. Tables without a given schema are inferred; an unreadable one is logged and left out."""

    def load(directory: str, synthetic: bool) -> dict[str, DataFrame]:
        found = {}
        suffix = SYNTHETIC_SUFFIX if synthetic else ""
        for name in csv_table_names(spark, directory, synthetic):
            reader = spark.read.option("header", True)
            reader = reader.schema(schemas[name]) if name in (schemas or {}) else reader.option("inferSchema", True)
            try:
                found[name] = reader.csv(f"{directory}/{name}{suffix}.csv")
            except AnalysisException as problem:
                log.error("Error loading %s: %s", name, problem)
        return found

    return load(real_dir, False), load(synth_dir, True)


def common_tables(real: dict[str, DataFrame], synth: dict[str, DataFrame]) -> list[str]:
    """Tables present in both sets; without any, an evaluation has nothing to compare."""
    return [t for t in real if t in synth]


def scan_csv_folder(spark: SparkSession, directory: str, synthetic: bool = False) -> DataFrame:
    """Lines of every CSV file of a folder beside their table name, as an inventory."""
    glob = f"*{SYNTHETIC_SUFFIX}.csv" if synthetic else "*.csv"
    lines = spark.read.option("pathGlobFilter", glob).text(directory)
    return lines.select(table_name(F.col("_metadata.file_name"), synthetic).alias("table_name"), "value")


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> str:
    """Write one table in the chosen format; CSV gets a header."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is no format of this sink; it writes {FORMATS}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path


def write_set(tables: dict[str, DataFrame], directory: str, fmt: str = "csv", prefix: str = "") -> dict[str, str]:
    """One output per table; returns the paths by table name."""
    return {t: write_table(df, f"{directory}/{prefix}{t}.{fmt}", fmt) for t, df in tables.items()}


def read_table(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_report(report: DataFrame, path: str) -> str:
    """Long-format report as JSON lines."""
    report.write.mode("overwrite").json(path)
    return path


# --- file listings -------------------------------------------------------------------------


def file_inventory(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Name, size, change time, extension and MD5 of files, newest first."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(directory)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"),
        F.md5("content").alias("hash"),
    ).orderBy(F.col("modified").desc(), "path")


def storage_stats(spark: SparkSession, directories: dict[str, str]) -> DataFrame:
    """Bytes and files per named folder and in total. File contents are not read."""
    listed = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("directory"), F.col("length").alias("n"))
        for name, path in directories.items()
    ]
    return (
        reduce(lambda a, b: a.unionByName(b), listed)
        .rollup("directory")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("files"))
        .select(F.coalesce("directory", F.lit("*")).alias("directory"), "size", "files")
    )
