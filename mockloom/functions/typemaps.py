"""Type name normalisation: four fixed lookup tables and their column form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: declared SQL type -> seed strategy
STRATEGY = {
    "INT": "integer", "INTEGER": "integer", "BIGINT": "integer", "SMALLINT": "integer", "TINYINT": "integer",
    "VARCHAR": "string", "CHAR": "string", "TEXT": "text",
    "DECIMAL": "decimal", "FLOAT": "float", "DOUBLE": "float",
    "DATE": "date", "TIME": "time", "TIMESTAMP": "datetime", "DATETIME": "datetime",
    "BOOLEAN": "boolean", "BOOL": "boolean", "ENUM": "enum", "JSON": "json",
}
# fixed values: declared SQL type -> modelling role
ROLE = {
    "INT": "numerical", "INTEGER": "numerical", "BIGINT": "numerical", "SMALLINT": "numerical", "TINYINT": "numerical",
    "DECIMAL": "numerical", "FLOAT": "numerical", "DOUBLE": "numerical",
    "VARCHAR": "categorical", "TEXT": "categorical", "CHAR": "categorical", "ENUM": "categorical", "JSON": "categorical",
    "TIMESTAMP": "datetime", "DATETIME": "datetime", "DATE": "datetime", "TIME": "datetime",
    "BOOLEAN": "boolean", "BOOL": "boolean",
}
# fixed values: document value type -> catalogue type
DOCUMENT = {
    "str": "VARCHAR", "int": "INTEGER", "float": "DOUBLE", "bool": "BOOLEAN", "list": "ARRAY", "dict": "JSON",
    "ObjectId": "OBJECT_ID", "datetime": "TIMESTAMP", "NoneType": "NULL", "bytes": "BINARY",
    "Decimal128": "DECIMAL", "Regex": "REGEX",
}
# fixed values: graph property type -> catalogue type
GRAPH = {
    "STRING": "VARCHAR", "INTEGER": "INTEGER", "LONG": "BIGINT", "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE",
    "BOOLEAN": "BOOLEAN", "DATE": "DATE", "LOCAL_DATE_TIME": "TIMESTAMP", "DATE_TIME": "TIMESTAMP",
    "ZONED_DATE_TIME": "TIMESTAMP", "DURATION": "INTERVAL", "POINT": "GEOMETRY", "LIST": "ARRAY", "MAP": "JSON",
    "NODE": "OBJECT_ID", "RELATIONSHIP": "OBJECT_ID", "NULL": "NULL",
}


def mapped(table: dict[str, str], key: Column, default: Column) -> Column:
    """Literal map lookup with a default."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(literal, key), default)


def document_type(name: Column) -> Column:
    return mapped(DOCUMENT, name, F.upper(name))


def graph_type(name: Column) -> Column:
    return mapped(GRAPH, F.upper(name), F.upper(name))


KEY_TAGS = ("PRIMARY_KEY", "AUTO_INCREMENT")
FK_TAG = "FOREIGN_KEY_REFERENCES_"


def is_key(constraints: Column) -> Column:
    return F.coalesce(F.arrays_overlap(constraints, F.array(*[F.lit(t) for t in KEY_TAGS])), F.lit(False))


def is_foreign(constraints: Column) -> Column:
    return F.coalesce(F.exists(constraints, lambda c: c.startswith(FK_TAG)), F.lit(False))


def strategy(sql_type: Column, constraints: Column) -> Column:
    """Seed strategy of an attribute."""
    return (
        F.when(is_key(constraints), "primary_key")
        .when(is_foreign(constraints), "foreign_key")
        .otherwise(mapped(STRATEGY, F.upper(sql_type), F.lit("string")))
    )


def role(sql_type: Column, constraints: Column) -> Column:
    """Modelling role of an attribute."""
    return (
        F.when(is_key(constraints) | is_foreign(constraints), "id")
        .otherwise(mapped(ROLE, F.upper(sql_type), F.lit("categorical")))
    )
