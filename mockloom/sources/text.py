"""DDL files and row payloads kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(path)


def read_ddl(spark: SparkSession, path: str, extension: str = ".sql", max_bytes: int | None = None) -> DataFrame:
    """(path, value) of whole DDL files: UTF-8, or Latin-1 where that fails. With ``max_bytes``, see ``refused_ddl`` for the rest."""
    files = _files(spark, path, extension)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("value"))


def refused_ddl(spark: SparkSession, path: str, max_bytes: int, extension: str = ".sql") -> DataFrame:
    """(path, length, reason) of the files that ``read_ddl`` with this limit leaves out."""
    over = _files(spark, path, extension).filter(F.col("length") > max_bytes)
    return over.select("path", "length", F.format_string("larger than %d bytes", F.lit(max_bytes)).alias("reason"))


def unfence(raw: Column) -> Column:
    """Drop the ``` lines of a fenced block; other text only loses outer blanks."""
    bare = F.regexp_replace(raw, r"^\s+|\s+\z", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?m)^[ \t]*```.*$", ""), r"^\s+|\s+\z", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


ROWS = "array<map<string,string>>"


def payload_rows(payloads: DataFrame, raw: str, *keep: str) -> DataFrame:
    """One row per object of a JSON array payload; anything else yields nothing."""
    rows = F.from_json(unfence(F.col(raw)), ROWS)
    return payloads.filter(is_row_list(F.col(raw))).select(*keep, F.posexplode(rows).alias("position", "row"))


def payload_rejects(payloads: DataFrame, raw: str) -> DataFrame:
    """Payloads that are not JSON or not a list."""
    return payloads.filter(~is_row_list(F.col(raw)))


def is_row_list(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(unfence(raw))).startswith("ARRAY"), F.lit(False))
