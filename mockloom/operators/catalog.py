"""Reports, searches and upkeep over stored schema documents.

A stored schema is a row (schema_id, content_hash, filename, file_size,
created_at, user_id, source, databases). Most operators walk the nested
document inside its row with array functions, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mockloom.functions import typemaps
from mockloom.operators.levels import levels
from mockloom.operators.scan import dense_index, lookup_by_key

FK_PATTERN = r"^FOREIGN_KEY_REFERENCES_([^.]+)\.([^.]+)$"
FK_SPELLED = r"(?i)^FOREIGN KEY REFERENCES\s+(\w+)\s*\(\s*(\w+)\s*\)"


# --- document shape -----------------------------------------------------------------


def content_hash(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def schema_id(content: Column) -> Column:
    return F.concat(F.lit("schema_"), content_hash(content))


def all_tables(databases: Column) -> Column:
    """Every table of a document as one array, in document order."""
    return F.flatten(F.filter(F.transform(databases, lambda d: d.tables), lambda ts: ts.isNotNull()))


def all_attributes(databases: Column) -> Column:
    return F.flatten(F.filter(F.transform(all_tables(databases), lambda t: t.attributes), lambda a: a.isNotNull()))


def _count(array: Column) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0)).cast("bigint")


def with_counts(schemas: DataFrame) -> DataFrame:
    """Databases, tables and columns of each document."""
    d = F.col("databases")
    return schemas.select(
        "*",
        _count(d).alias("database_count"),
        _count(all_tables(d)).alias("table_count"),
        _count(all_attributes(d)).alias("column_count"),
    )


def explode_tables(schemas: DataFrame, *keep: str) -> DataFrame:
    return (
        schemas.select(*keep, F.posexplode("databases").alias("db_pos", "_db"))
        .select(*keep, "db_pos", F.col("_db.name").alias("database"), F.posexplode("_db.tables").alias("table_pos", "_t"))
        .select(*keep, "db_pos", "database", "table_pos", F.col("_t.name").alias("table_name"), F.col("_t.attributes").alias("attributes"))
    )


def flatten(schemas: DataFrame, *keep: str) -> DataFrame:
    """One row per attribute."""
    return (
        explode_tables(schemas, *keep)
        .select(*keep, "db_pos", "database", "table_pos", "table_name", F.posexplode("attributes").alias("ordinal", "_a"))
        .select(
            *keep, "db_pos", "database", "table_pos", "table_name", "ordinal",
            F.col("_a.name").alias("column_name"), F.col("_a.type").alias("type"), F.col("_a.type_params").alias("type_params"),
            F.col("_a.default").alias("default_value"), F.coalesce("_a.constraints", F.array().cast("array<string>")).alias("constraints"),
        )
    )


# --- upkeep ---------------------------------------------------------------------------


def upsert_by_hash(stored: DataFrame, incoming: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Last write per key. ``max_by`` combines map-side, so a key with many copies stays cheap."""
    both = stored.unionByName(incoming)
    whole = F.struct(*both.columns)
    newest = F.max_by(whole, F.struct(*version)).alias("_row")
    return both.groupBy(F.col(key).alias("_key")).agg(newest).select("_row.*")


def owned(schemas: DataFrame, user: str) -> DataFrame:
    return schemas.filter(F.col("user_id") == user)


def find(schemas: DataFrame, column: str, value: str, user: str | None = None) -> DataFrame:
    """Lookup by id or hash; someone else's schema counts as not found."""
    hits = schemas.filter(F.col(column) == value)
    return owned(hits, user) if user is not None else hits


def known(requests: DataFrame, schemas: DataFrame, column: str) -> DataFrame:
    """Requests whose key is stored."""
    return requests.join(schemas.select(column).distinct(), column, "left_semi")


SORTS = {"created_at": F.col, "file_size": F.col, "filename": lambda c: F.lower(F.col(c))}


def list_page(
    schemas: DataFrame, limit: int = 50, offset: int = 0, sort_by: str = "created_at", descending: bool = True, search: str | None = None
) -> DataFrame:
    """One page with the total and whether more follows. Ties are ordered by id."""
    found = schemas.filter(F.contains(F.lower("filename"), F.lit(search.lower()))) if search else schemas
    total = found.agg(F.count(F.lit(1))).scalar()
    lead = [SORTS[sort_by](sort_by)] if sort_by in SORTS else []
    order = [c.desc() if descending else c.asc() for c in [*lead, F.col("schema_id")]]
    page = found.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def latest(schemas: DataFrame) -> DataFrame:
    return schemas.orderBy(F.col("created_at").desc(), F.col("schema_id").desc()).limit(1)


def retention(schemas: DataFrame, cap: int = 100) -> DataFrame:
    """At or above the cap, drop the oldest fifth (at least one)."""
    positions = dense_index(schemas.select("created_at", "schema_id"), ["created_at", "schema_id"], "position")
    total = positions.agg(F.count(F.lit(1))).scalar()
    doomed = positions.filter((total >= cap) & (F.col("position") < F.greatest(F.lit(1), F.floor(total / 5))))
    return schemas.join(doomed.select("schema_id"), "schema_id", "left_anti")


def bulk_delete(schemas: DataFrame, requests: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, report). The report tells per requested id whether it was deleted."""
    asked = requests.select("schema_id").distinct()
    mine = owned(schemas, user).select("schema_id", "filename")
    report = asked.join(mine, "schema_id", "left").select(
        "schema_id", "filename", F.when(F.col("filename").isNull(), "not_found").otherwise("deleted").alias("outcome")
    )
    gone = report.filter("outcome = 'deleted'").select("schema_id")
    return schemas.join(gone, "schema_id", "left_anti"), report


def update_by_hash(schemas: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite the given columns where a change for the hash carries a value."""
    new = changes.select("content_hash", *[F.col(c).alias(f"_new_{c}") for c in columns])
    return schemas.join(new, "content_hash", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in schemas.columns]
    )


# --- searches -------------------------------------------------------------------------


def search_table(schemas: DataFrame, name: str) -> DataFrame:
    return schemas.filter(F.exists(all_tables(F.col("databases")), lambda t: F.lower(t["name"]) == name.lower()))


def search_column(schemas: DataFrame, name: str) -> DataFrame:
    """Hits (database, table, column) of a column name, one row each."""
    return flatten(schemas, "schema_id").filter(F.lower("column_name") == name.lower())


def table_analysis(schemas: DataFrame, name: str) -> DataFrame:
    """Keys, references, unique and nullable columns of the first table of that name."""
    pairs = F.flatten(
        F.transform(
            "databases",
            lambda d: F.transform(
                F.filter(d.tables, lambda t: F.lower(t["name"]) == name.lower()),
                lambda t: F.struct(d["name"].alias("database"), t.attributes.alias("attributes")),
            ),
        )
    )
    found = schemas.select("schema_id", F.get(pairs, F.lit(0)).alias("t")).filter(F.col("t").isNotNull())
    a = F.coalesce("t.attributes", F.array().cast("array<struct<name:string,type:string,type_params:string,default:string,constraints:array<string>>>"))
    names = lambda test: F.transform(F.filter(a, test), lambda x: x["name"])
    has = lambda tag: (lambda x: F.coalesce(F.array_contains(x.constraints, tag), F.lit(False)))
    links = F.flatten(
        F.transform(
            a,
            lambda x: F.transform(
                F.filter(F.coalesce(x.constraints, F.array().cast("array<string>")), lambda c: c.rlike(FK_PATTERN)),
                lambda c: F.concat(x["name"], F.lit("->"), F.regexp_extract(c, FK_PATTERN, 1), F.lit("."), F.regexp_extract(c, FK_PATTERN, 2)),
            ),
        )
    )
    return found.select(
        "schema_id",
        F.col("t.database").alias("database"),
        _count(a).alias("total_columns"),
        names(has("PRIMARY_KEY")).alias("primary_keys"),
        links.alias("foreign_keys"),
        names(has("UNIQUE")).alias("unique_columns"),
        names(lambda x: ~has("NOT_NULL")(x)).alias("nullable_columns"),
    )


# --- statistics -----------------------------------------------------------------------


def summary(schemas: DataFrame) -> DataFrame:
    """Per database: table count and, per table, column count and key columns."""
    tables = F.coalesce("_db.tables", F.array().cast("array<struct<name:string,attributes:array<struct<name:string,type:string,type_params:string,default:string,constraints:array<string>>>>>"))
    keys = lambda t: F.transform(
        F.filter(t.attributes, lambda a: F.coalesce(F.array_contains(a.constraints, "PRIMARY_KEY"), F.lit(False))), lambda a: a["name"]
    )
    detail = F.transform(
        tables,
        lambda t: F.struct(t["name"].alias("name"), _count(t.attributes).alias("column_count"), keys(t).alias("primary_keys")),
    )
    return schemas.select("schema_id", F.explode("databases").alias("_db")).select(
        "schema_id", F.col("_db.name").alias("database"), _count(tables).alias("table_count"), detail.alias("tables")
    )


def statistics(schemas: DataFrame, cap: int = 100) -> DataFrame:
    """Totals over all stored schemas, zero when there are none."""
    counted = with_counts(schemas)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counted.agg(
        F.count(F.lit(1)).alias("total_schemas"),
        total("database_count").alias("total_databases"),
        total("table_count").alias("total_tables"),
        total("column_count").alias("total_attributes"),
        total("file_size").alias("total_storage_bytes"),
    ).withColumn("usage_percentage", F.col("total_schemas") / cap * 100)


def constraint_distribution(schemas: DataFrame) -> DataFrame:
    tags = schemas.select(F.explode(F.transform(all_attributes(F.col("databases")), lambda a: a.constraints)).alias("c"))
    return tags.select(F.explode("c").alias("constraint_tag")).groupBy("constraint_tag").agg(F.count(F.lit(1)).alias("n"))


def type_distribution(schemas: DataFrame) -> DataFrame:
    types = F.explode(F.transform(all_attributes(F.col("databases")), lambda a: F.coalesce(a.type, F.lit("UNKNOWN"))))
    return schemas.select(types.alias("data_type")).groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


# --- relational catalogue ---------------------------------------------------------------


def assemble(columns: DataFrame, pks: DataFrame, uniques: DataFrame, fks: DataFrame) -> DataFrame:
    """Attributes from information-schema rows.

    The three key lists become one list of tags per column, so the columns are
    shuffled once for one left join.
    """
    tag = lambda df, place, text: df.select("table_name", "column_name", F.struct(F.lit(place).alias("p"), text.alias("t")).alias("tag"))
    tags = (
        tag(pks, 1, F.lit("PRIMARY_KEY"))
        .unionByName(tag(uniques, 2, F.lit("UNIQUE")))
        .unionByName(tag(fks, 3, F.concat(F.lit(typemaps.FK_TAG), F.col("ft"), F.lit("."), F.col("fc"))))
        .groupBy("table_name", "column_name")
        .agg(F.transform(F.array_sort(F.collect_set("tag")), lambda x: x.t).alias("key_tags"))
    )
    own = F.array_compact(
        F.array(
            F.when(F.col("is_nullable") == "NO", "NOT_NULL"),
            F.when(F.contains(F.lower("column_default"), F.lit("nextval")), "AUTO_INCREMENT"),
        )
    )
    return columns.join(tags, ["table_name", "column_name"], "left").select(
        "table_name",
        "column_name",
        F.upper("data_type").alias("type"),
        F.col("character_maximum_length").cast("string").alias("type_params"),
        F.col("column_default").alias("default_value"),
        F.concat(own, F.coalesce("key_tags", F.array().cast("array<string>"))).alias("constraints"),
    )


def attach_policies(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """Every table with its policies, one row each; tables without any keep one empty row."""
    hits = lookup_by_key(policies, tables, ["table_name"])
    bare = tables.join(policies.select("table_name").distinct(), "table_name", "left_anti")
    return hits.unionByName(bare, allowMissingColumns=True)


def apply_indexes(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """Index facts as constraint tags: UNIQUE, PRIMARY_KEY for ``_id_``, INDEXED otherwise."""
    facts = indexes.groupBy(F.col("key").alias("column_name")).agg(
        F.max("unique").alias("u"), F.max(F.col("index_name") == "_id_").alias("p"), F.max(F.col("index_name") != "_id_").alias("i")
    )
    added = F.array_compact(F.array(F.when(F.col("u"), "UNIQUE"), F.when(F.col("p"), "PRIMARY_KEY"), F.when(F.col("i"), "INDEXED")))
    return attributes.join(facts, "column_name", "left").select(
        *[F.array_union("constraints", added).alias("constraints") if c == "constraints" else F.col(c) for c in attributes.columns]
    )


# --- references and order ---------------------------------------------------------------


def _reference(tag: Column, part: int) -> Column:
    plain = F.regexp_extract(tag, FK_PATTERN, part)
    return F.when(plain != "", plain).otherwise(F.regexp_extract(tag, FK_SPELLED, part))


def fk_edges(attributes: DataFrame, *keep: str) -> DataFrame:
    """(child, column, parent, parent column) from flattened attributes, either constraint spelling."""
    return (
        attributes.select(*keep, "table_name", "column_name", F.explode("constraints").alias("tag"))
        .select(
            *keep,
            F.col("table_name").alias("child"),
            F.col("column_name").alias("child_column"),
            _reference(F.col("tag"), 1).alias("parent"),
            _reference(F.col("tag"), 2).alias("parent_column"),
        )
        .filter(F.col("parent") != "")
    )


def generation_levels(schemas: DataFrame, *keep: str, strict: bool = False) -> DataFrame:
    """Level of every table: parents come before children (see ``levels``).

    Tables of one document are told apart by name; unknown parents, and references of a table to itself, do not count.
    """
    named = schemas.select(*keep, "databases", F.sha2(F.to_json("databases"), 256).alias("doc"))
    documents = named.select("doc", "databases").dropDuplicates(["doc"])
    nodes = explode_tables(documents, "doc").where("table_name is not null").select("doc", F.col("table_name").alias("name")).distinct()
    edges = fk_edges(flatten(documents, "doc"), "doc").where("child != parent").select("doc", "child", "parent").distinct()
    edges = edges.join(nodes.withColumnRenamed("name", "parent"), ["doc", "parent"], "left_semi")
    out = levels(nodes, edges, strict)
    return named.select(*keep, "doc").join(out, "doc").select(*keep, F.col("name").alias("table_name"), "level")


def column_roles(attributes: DataFrame, *keep: str) -> DataFrame:
    """Modelling role per column."""
    return attributes.select(*keep, "table_name", "column_name", typemaps.role(F.col("type"), F.col("constraints")).alias("role"))


def primary_keys(schemas: DataFrame, *keep: str) -> DataFrame:
    """Primary key per table; the last declared one wins."""
    keyed = F.filter("attributes", lambda a: typemaps.is_key(a.constraints))
    return (
        explode_tables(schemas, *keep)
        .select(*keep, "database", "table_name", F.try_element_at(F.transform(keyed, lambda a: a["name"]), F.lit(-1)).alias("primary_key"))
        .filter(F.col("primary_key").isNotNull())
    )


def relationships(attributes: DataFrame, *keep: str) -> DataFrame:
    """Parent, its key, child and foreign key of every reference to a table of the same document."""
    known = attributes.select(*keep, F.col("table_name").alias("parent")).distinct()
    return fk_edges(attributes, *keep).join(known, [*keep, "parent"], "left_semi").select(
        *keep, "parent", F.col("parent_column").alias("parent_key"), "child", F.col("child_column").alias("foreign_key")
    )
