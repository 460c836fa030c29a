"""Schema inference for JSON documents and property graphs, over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mockloom.functions import typemaps
from mockloom.operators.scan import lookup_by_key

DEPTH = 5  # path components that are followed unless asked otherwise
# fixed values: variant type -> document value type / graph property type
VARIANT_TO_DOCUMENT = {
    "BIGINT": "int", "STRING": "str", "DOUBLE": "float", "DECIMAL": "float", "FLOAT": "float", "BOOLEAN": "bool",
    "VOID": "NoneType", "ARRAY": "list", "OBJECT": "dict", "BINARY": "bytes", "TIMESTAMP": "datetime", "TIMESTAMP_NTZ": "datetime",
}
VARIANT_TO_GRAPH = {
    "BIGINT": "INTEGER", "STRING": "STRING", "DOUBLE": "FLOAT", "DECIMAL": "FLOAT", "FLOAT": "FLOAT", "BOOLEAN": "BOOLEAN",
    "VOID": "NULL", "ARRAY": "LIST", "OBJECT": "MAP", "DATE": "DATE", "TIMESTAMP": "DATE_TIME", "TIMESTAMP_NTZ": "LOCAL_DATE_TIME",
}


def _kind(value: Column, names: dict[str, str]) -> Column:
    base = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    return typemaps.mapped(names, base, base)


# --- documents --------------------------------------------------------------------------


def sample(docs: DataFrame, order: str, size: int = 100) -> DataFrame:
    """First documents by a key; the size is a request parameter between 1 and 10000."""
    if not 1 <= size <= 10_000:
        raise ValueError("sample size must lie between 1 and 10000")
    return docs.orderBy(order).limit(size)


def user_collections(collections: DataFrame) -> DataFrame:
    """Drop system collections and the server's own databases."""
    return collections.filter(
        ~F.col("collection").startswith("system.") & ~F.col("database").isin("admin", "local", "config")
    )


def document_paths(docs: DataFrame, doc: str, depth: int = DEPTH) -> DataFrame:
    """(path, type) of every field of every document, in one pass.

    Fields below ``depth`` components are not listed one by one; the object that
    holds them is, as JSON. One outer explode for each level follows the paths down; an inner field is reported on
    the row of its first child only, so it counts once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.try_parse_json(doc).alias("v0"))
    for i in range(1, depth + 1):
        field = spark.tvf.variant_explode_outer(F.col(f"v{i - 1}").outer()).toDF(f"p{i}", f"k{i}", f"v{i}")
        rows = rows.lateralJoin(field)
        # arrays are not descended
        rows = rows.withColumn(f"v{i}x", F.when(F.schema_of_variant(f"v{i}").startswith("OBJECT"), F.col(f"v{i}")))
        rows = rows.withColumnsRenamed({f"v{i}": f"t{i}", f"v{i}x": f"v{i}"})
    cells = []
    for i in range(1, depth + 1):
        first = F.col(f"k{i}").isNotNull()
        for j in range(i + 1, depth + 1):
            first = first & (F.coalesce(F.col(f"p{j}"), F.lit(0)) == 0)
        path = F.concat_ws(".", *[F.col(f"k{j}") for j in range(1, i + 1)])
        kind = typemaps.document_type(_kind(F.col(f"t{i}"), VARIANT_TO_DOCUMENT))
        cells.append(F.when(first, F.struct(path.alias("path"), kind.alias("type"))))
    return rows.select(F.inline(F.array_compact(F.array(*cells))))


def infer_documents(docs: DataFrame, doc: str, depth: int = DEPTH) -> DataFrame:
    """Fields with dominant type and nullability. Equal counts go to the later type name."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    histogram = document_paths(docs, doc, depth).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
    fields = histogram.groupBy("path").agg(
        F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("seen")
    )
    tags = F.array_compact(
        F.array(
            F.when(F.col("path") == "_id", "PRIMARY_KEY"),
            F.when(F.col("seen") < total, "NULLABLE").otherwise("NOT_NULL"),
        )
    )
    return fields.select(F.col("path").alias("column_name"), "type", "seen", tags.alias("constraints"))


# --- property graphs ------------------------------------------------------------------------
# nodes(id, labels array<string>, props variant), edges(src, dst, type, props variant)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("node_count"))


def node_attributes(nodes: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """Property keys per label with their most frequent type and declared constraints."""
    field = nodes.sparkSession.tvf.variant_explode(F.col("props").outer()).toDF("_p", "key", "value")
    seen = (
        nodes.select(F.explode("labels").alias("label"), "props")
        .lateralJoin(field)
        .groupBy("label", "key", typemaps.graph_type(_kind(F.col("value"), VARIANT_TO_GRAPH)).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = seen.groupBy("label", "key").agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    if constraints is None:
        return found.withColumn("constraints", F.array().cast("array<string>"))
    kind = F.upper("type")
    tags = constraints.select(
        "label",
        "key",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.contains(kind, F.lit("UNIQUE")), "UNIQUE"),
                    F.when(F.contains(kind, F.lit("NOT NULL")) | F.contains(kind, F.lit("EXIST")), "NOT_NULL"),
                )
            )
        ).alias("tag"),
    ).groupBy("label", "key").agg(F.array_sort(F.collect_set("tag")).alias("constraints"))
    return found.join(tags, ["label", "key"], "left").withColumn(
        "constraints", F.coalesce("constraints", F.array().cast("array<string>"))
    )


def _tagged(edges: DataFrame, nodes: DataFrame, end: str, label: Column, name: str) -> DataFrame:
    """Attach a label of one end of each edge."""
    return lookup_by_key(edges, nodes.select(F.col("id").alias(end), label.alias(name)), [end])


def _head(labels: str = "labels") -> Column:
    return F.get(F.col(labels), F.lit(0))


def node_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (label, relationship type, label of the target), 'Unknown' for unlabelled targets."""
    to_target = _tagged(edges.select("src", "dst", "type"), nodes, "dst", _head(), "target")
    shrunk = to_target.select("src", "type", F.coalesce("target", F.lit("Unknown")).alias("target")).distinct()
    from_source = _tagged(shrunk, nodes, "src", F.col("labels"), "_labels")
    return from_source.select(F.explode("_labels").alias("label"), "type", "target").distinct()


def relationship_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (type, source label, target label), first labels only."""
    to_target = _tagged(edges.select("src", "dst", "type"), nodes, "dst", _head(), "target")
    shrunk = to_target.select("src", "type", "target").distinct()
    return _tagged(shrunk, nodes, "src", _head(), "source").select("type", "source", "target").distinct()


def relationship_profile(edges: DataFrame) -> DataFrame:
    """Count and property keys per relationship type."""
    counts = edges.groupBy("type").agg(F.count(F.lit(1)).alias("relationship_count"))
    field = edges.sparkSession.tvf.variant_explode(F.col("props").outer()).toDF("_p", "key", "value")
    keys = edges.select("type", "props").lateralJoin(field).select("type", "key").distinct()
    listed = keys.groupBy("type").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return counts.join(listed, "type", "left").select(
        "type", "relationship_count", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")
    )


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "relationships"))
