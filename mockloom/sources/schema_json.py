"""Schema documents as JSON text: reading, unwrapping and shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = "struct<name:string,type:string,type_params:string,default:string,constraints:array<string>>"
TABLE = f"struct<name:string,attributes:array<{ATTRIBUTE}>>"
DATABASES = f"array<struct<name:string,tables:array<{TABLE}>>>"
SCHEMA_DOC = f"struct<databases:{DATABASES}>"
PAYLOAD = f"struct<schema:{SCHEMA_DOC},databases:{DATABASES}>"


def parse_payload(payload: Column) -> Column:
    """Databases of a document given bare or wrapped as ``{"schema": ...}``."""
    parsed = F.from_json(payload, PAYLOAD)
    return F.coalesce(parsed.schema.databases, parsed.databases)


def read_schema_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file below ``path``; malformed files give null databases."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("payload"),
        parse_payload(F.col("value")).alias("databases"),
    )


def is_valid(payload: Column) -> Column:
    """An object whose database and table lists, where present, hold named entries."""
    parsed = F.from_json(payload, SCHEMA_DOC)
    named = F.forall(
        F.coalesce(parsed.databases, F.expr(f"from_json('[]', '{DATABASES}')")),
        lambda d: d["name"].isNotNull()
        & F.forall(F.coalesce(d.tables, F.expr(f"from_json('[]', 'array<{TABLE}>')")), lambda t: t["name"].isNotNull()),
    )
    # a variant keeps the difference between "absent" and "not a list" that a typed read loses
    raw = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(raw, "$.databases", "variant"))
    listed = kind.isNull() | kind.startswith("ARRAY")
    whole = F.schema_of_variant(raw).startswith("OBJECT")
    return F.coalesce(whole & listed & named, F.lit(False))
