"""Catalogue queries. Each row of ``documents`` stands for one uploaded schema."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from mockloom.functions import typemaps
from mockloom.functions.typemaps import FK_TAG
from mockloom.operators import catalog as cat
from mockloom.plans.derive import table
from mockloom.plans.registry import query
from mockloom.sources.schema_json import is_valid, parse_payload

NAMES = ["users", "Orders", "items", "EVENTS", "logs"]
COLUMNS = ["id", "user_id", "email", "amount", "item_id"]
TYPES = ["BIGINT", "INT", "VARCHAR", "DECIMAL", "TIMESTAMP"]

# --- the same documents in Spark and in SQL -----------------------------------------------


def _at(words, index):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _span(n):
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _document():
    d = F.col("doc_id")

    def tags(i, j, k):
        late = _at(NAMES, d + i + j).isin("EVENTS", "logs")
        return (
            F.when(k == 0, F.array_compact(F.array(F.lit("PRIMARY_KEY"), F.lit("NOT_NULL"), F.when(d % 3 == 0, "AUTO_INCREMENT"))))
            .when(k == 1, F.array(F.lit(FK_TAG + "users.id")))
            .when((k == 2) & ((d + j) % 2 == 0), F.array(F.lit("UNIQUE")))
            .when(k == 3, F.array(F.lit("NOT_NULL")))
            .when((k == 4) & late, F.array(F.lit(FK_TAG + "items.id")))
            .otherwise(F.array().cast("array<string>"))
        )

    attribute = lambda i, j, k: F.struct(
        _at(COLUMNS, k).alias("name"),
        F.when((d + k) % 11 != 0, _at(TYPES, k)).alias("type"),
        F.when(k == 2, "255").when(k == 3, "10,2").alias("type_params"),
        F.when(k == 3, "0").alias("default"),
        tags(i, j, k).alias("constraints"),
    )
    tab = lambda i, j: F.struct(
        _at(NAMES, d + i + j).alias("name"),
        F.transform(_span(2 + (d + i + j) % 4), lambda k: attribute(i, j, k)).alias("attributes"),
    )
    base = lambda i: F.struct(
        F.concat(F.lit("db"), i.cast("string")).alias("name"),
        F.transform(_span((d + i) % 4), lambda j: tab(i, j)).alias("tables"),
    )
    return F.struct(F.transform(_span(1 + d % 2), base).alias("databases"))


def payloads(spark, sf_dir):
    """Uploads as JSON text, every other one wrapped in ``{"schema": ...}``."""
    doc = _document()
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(doc.alias("schema")))).otherwise(F.to_json(doc))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        cat.schema_id(F.col("doc_id").cast("string")).alias("schema_id"),
        cat.content_hash(F.col("doc_id").cast("string")).alias("content_hash"),
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".SQL"))).alias("filename"),
        F.col("n_chars").alias("file_size"),
        (F.lit(1.7e9) + (F.col("doc_id") * 7919) % 1000).alias("created_at"),
        F.col("lang").alias("user_id"),
        F.when(F.col("source") != "src0", F.col("source")).alias("source"),
        text.alias("payload"),
    )


def schemas(spark, sf_dir):
    return payloads(spark, sf_dir).withColumn("databases", parse_payload(F.col("payload"))).drop("payload")


_pick = lambda words, i: "([" + ", ".join(f"'{w}'" for w in words) + f"])[(({i}) % {len(words)} + 1)::INT]"
SCHEMAS = f"""
schemas AS (SELECT doc_id AS d, 'schema_' || md5(doc_id::VARCHAR) AS schema_id, md5(doc_id::VARCHAR) AS content_hash,
  source || '_' || doc_id || '.SQL' AS filename, n_chars AS file_size, 1.7e9::DOUBLE + (doc_id * 7919) % 1000 AS created_at,
  lang AS user_id, nullif(source, 'src0') AS source FROM documents),
dbs AS (SELECT *, unnest(range(0, 1 + d % 2)) AS i FROM schemas),
tabs AS (SELECT *, {_pick(NAMES, 'd + i + j')} AS table_name, 2 + (d + i + j) % 4 AS n_cols FROM (SELECT *, unnest(range(0, (d + i) % 4)) AS j FROM dbs)),
attrs AS (SELECT *, 'db' || i AS database, {_pick(COLUMNS, 'k')} AS column_name, CASE WHEN (d + k) % 11 <> 0 THEN {_pick(TYPES, 'k')} END AS type,
  CASE k WHEN 2 THEN '255' WHEN 3 THEN '10,2' END AS type_params, CASE k WHEN 3 THEN '0' END AS default_value,
  CASE WHEN k = 0 AND d % 3 = 0 THEN ['PRIMARY_KEY', 'NOT_NULL', 'AUTO_INCREMENT'] WHEN k = 0 THEN ['PRIMARY_KEY', 'NOT_NULL']
       WHEN k = 1 THEN ['{FK_TAG}users.id'] WHEN k = 2 AND (d + j) % 2 = 0 THEN ['UNIQUE'] WHEN k = 3 THEN ['NOT_NULL']
       WHEN k = 4 AND table_name IN ('EVENTS', 'logs') THEN ['{FK_TAG}items.id'] ELSE []::VARCHAR[] END AS tags
  FROM (SELECT *, unnest(range(0, n_cols)) AS k FROM tabs))"""
_joined = lambda c: F.concat_ws("|", c)


@query(
    "schema_flatten",
    f"""WITH {SCHEMAS} SELECT schema_id, database, table_name, k::INT AS ordinal, column_name, type, type_params, default_value,
 array_to_string(tags, '|') AS constraints FROM attrs""",
)
def schema_flatten(spark, sf_dir):
    flat = cat.flatten(schemas(spark, sf_dir), "schema_id").drop("db_pos", "table_pos")
    return flat.withColumn("constraints", _joined("constraints"))


@query(
    "scan_schema_json",
    f"""WITH {SCHEMAS}, db_n AS (SELECT schema_id, count(*) AS n FROM dbs GROUP BY 1), t_n AS (SELECT schema_id, count(*) AS n, sum(n_cols)::BIGINT AS c FROM tabs GROUP BY 1)
SELECT schema_id, db_n.n AS database_count, coalesce(t_n.n, 0) AS table_count, coalesce(c, 0) AS column_count
FROM schemas LEFT JOIN db_n USING (schema_id) LEFT JOIN t_n USING (schema_id)""",
)
def scan_schema_json(spark, sf_dir):
    from mockloom.session import scratch_path
    from mockloom.sources.tables import read_json_column

    path = scratch_path(spark, "schema-json")
    payloads(spark, sf_dir).select("schema_id", "payload").write.json(path)
    stored = read_json_column(spark, path, "schema_id string, payload string")
    parsed = stored.withColumn("databases", parse_payload(F.col("payload")))
    return cat.with_counts(parsed).select("schema_id", "database_count", "table_count", "column_count")


@query(
    "schema_counts",
    f"""WITH {SCHEMAS} SELECT user_id, (SELECT count(*) FROM dbs WHERE dbs.user_id = s.user_id) AS databases,
 (SELECT count(*) FROM tabs WHERE tabs.user_id = s.user_id) AS tables, (SELECT count(*) FROM attrs WHERE attrs.user_id = s.user_id) AS columns
 FROM (SELECT DISTINCT user_id FROM schemas) AS s""",
)
def schema_counts(spark, sf_dir):
    counted = cat.with_counts(schemas(spark, sf_dir)).groupBy("user_id")
    return counted.agg(F.sum("database_count").alias("databases"), F.sum("table_count").alias("tables"), F.sum("column_count").alias("columns"))


@query(
    "schema_validate",
    """SELECT doc_id, doc_id % 5 NOT IN (1, 2, 4) AS valid FROM documents""",
)
def schema_validate(spark, sf_dir):
    case = F.col("doc_id") % 5
    broken = (
        F.when(case == 1, F.lit('{"databases": [{"tables": []}]}'))  # unnamed database
        .when(case == 2, F.substring("text", 1, 1 << 30))  # no JSON at all
        .when(case == 3, F.lit('{"name": "empty"}'))  # no database list: valid
        .when(case == 4, F.lit('{"databases": "none"}'))  # not a list
        .otherwise(F.to_json(_document()))
    )
    return table(spark, sf_dir, "documents").select("doc_id", is_valid(broken).alias("valid"))


# --- identity and upkeep -------------------------------------------------------------------


@query("content_hash", "SELECT doc_id, md5(text) AS content_hash, 'schema_' || md5(text) AS schema_id FROM documents")
def content_hash(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", cat.content_hash(text).alias("content_hash"), cat.schema_id(text).alias("schema_id"))


@query(
    "upsert_by_hash",
    """WITH v AS (SELECT md5(text) AS content_hash, source, 1 AS version, doc_id FROM documents UNION ALL
 SELECT md5(text), 'again', 2, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT content_hash, source, version, doc_id FROM v QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY version DESC, doc_id DESC) = 1""",
)
def upsert_by_hash(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    row = lambda df, source, version: df.select(
        cat.content_hash(F.col("text")).alias("content_hash"), source.alias("source"), F.lit(version).alias("version"), "doc_id"
    )
    again = docs.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return cat.upsert_by_hash(row(docs, F.col("source"), 1), row(again, F.lit("again"), 2), "content_hash", ["version", "doc_id"])


@query(
    "lookup_user_scope",
    f"""WITH {SCHEMAS} SELECT schema_id, filename, file_size FROM schemas WHERE user_id = 'fr'
 AND content_hash IN (SELECT md5(doc_id::VARCHAR) FROM labels WHERE quality = 1)""",
)
def lookup_user_scope(spark, sf_dir):
    stored = cat.owned(schemas(spark, sf_dir), "fr")
    asked = table(spark, sf_dir, "labels").filter("quality = 1").select(cat.content_hash(F.col("doc_id").cast("string")).alias("content_hash"))
    return cat.known(stored, asked, "content_hash").select("schema_id", "filename", "file_size")


@query(
    "list_paginate",
    f"""WITH {SCHEMAS}, f AS (SELECT * FROM schemas WHERE contains(lower(filename), 'src1')),
p AS (SELECT * FROM f ORDER BY created_at DESC, schema_id DESC LIMIT 50 OFFSET 25)
SELECT schema_id, filename, created_at, file_size, content_hash, (SELECT count(*) FROM tabs WHERE tabs.schema_id = p.schema_id) AS table_count,
 (SELECT count(*) FROM f) AS total, 75 < (SELECT count(*) FROM f) AS has_more FROM p""",
)
def list_paginate(spark, sf_dir):
    page = cat.list_page(schemas(spark, sf_dir), limit=50, offset=25, search="SRC1")
    return cat.with_counts(page).select("schema_id", "filename", "created_at", "file_size", "content_hash", "table_count", "total", "has_more")


@query("latest_by", f"WITH {SCHEMAS} SELECT schema_id, filename, created_at FROM schemas ORDER BY created_at DESC, schema_id DESC LIMIT 1")
def latest_by(spark, sf_dir):
    return cat.latest(schemas(spark, sf_dir)).select("schema_id", "filename", "created_at")


@query(
    "retention_trim",
    f"""WITH {SCHEMAS} SELECT schema_id, created_at FROM schemas QUALIFY (SELECT count(*) FROM schemas) < 100
 OR row_number() OVER (ORDER BY created_at, schema_id) > greatest(1, (SELECT count(*) FROM schemas) // 5)""",
)
def retention_trim(spark, sf_dir):
    return cat.retention(schemas(spark, sf_dir)).select("schema_id", "created_at")


REQUESTS = "requests AS (SELECT DISTINCT 'schema_' || md5(doc_id::VARCHAR) AS schema_id FROM labels UNION ALL SELECT 'schema_' || url FROM pages)"


def _requests(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(cat.schema_id(F.col("doc_id").cast("string")).alias("schema_id"))
    return wanted.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("schema_"), "url").alias("schema_id")))


@query(
    "bulk_delete",
    f"""WITH {SCHEMAS}, {REQUESTS} SELECT DISTINCT r.schema_id, filename, CASE WHEN filename IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome
 FROM requests r LEFT JOIN (SELECT * FROM schemas WHERE user_id = 'en') s USING (schema_id)""",
)
def bulk_delete(spark, sf_dir):
    return cat.bulk_delete(schemas(spark, sf_dir), _requests(spark, sf_dir), "en")[1]


@query(
    "bulk_delete_survivors",
    f"""WITH {SCHEMAS}, {REQUESTS} SELECT user_id, count(*) AS n FROM schemas
 WHERE NOT (user_id = 'en' AND schema_id IN (SELECT schema_id FROM requests)) GROUP BY user_id""",
)
def bulk_delete_survivors(spark, sf_dir):
    kept = cat.bulk_delete(schemas(spark, sf_dir), _requests(spark, sf_dir), "en")[0]
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "update_by_hash",
    f"""WITH {SCHEMAS} SELECT schema_id, CASE WHEN quality = 1 THEN 'renamed_' || d ELSE filename END AS filename, file_size
 FROM schemas LEFT JOIN labels ON d = labels.doc_id""",
)
def update_by_hash(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    changes = table(spark, sf_dir, "labels").select(
        cat.content_hash(d).alias("content_hash"), F.when(F.col("quality") == 1, F.concat(F.lit("renamed_"), d)).alias("filename")
    )
    return cat.update_by_hash(schemas(spark, sf_dir), changes, ["filename"]).select("schema_id", "filename", "file_size")


# --- searches ---------------------------------------------------------------------------------


@query("search_table", f"WITH {SCHEMAS} SELECT DISTINCT schema_id, filename FROM tabs WHERE lower(table_name) = 'orders'")
def search_table(spark, sf_dir):
    return cat.search_table(schemas(spark, sf_dir), "ORDERS").select("schema_id", "filename")


@query("search_column", f"WITH {SCHEMAS} SELECT schema_id, database, table_name, column_name, type FROM attrs WHERE column_name = 'amount'")
def search_column(spark, sf_dir):
    return cat.search_column(schemas(spark, sf_dir), "Amount").select("schema_id", "database", "table_name", "column_name", "type")


@query(
    "table_analysis",
    f"""WITH {SCHEMAS}, hit AS (SELECT * FROM attrs WHERE lower(table_name) = 'events'
   QUALIFY dense_rank() OVER (PARTITION BY schema_id ORDER BY i, j) = 1)
SELECT schema_id, database, count(*) AS total_columns, coalesce(string_agg(CASE WHEN list_contains(tags, 'PRIMARY_KEY') THEN column_name END, '|' ORDER BY k), '') AS primary_keys,
 coalesce(string_agg(CASE WHEN tags[1] LIKE 'FOREIGN%' THEN column_name || '->' || replace(tags[1], '{FK_TAG}', '') END, '|' ORDER BY k), '') AS foreign_keys,
 coalesce(string_agg(CASE WHEN list_contains(tags, 'UNIQUE') THEN column_name END, '|' ORDER BY k), '') AS unique_columns,
 coalesce(string_agg(CASE WHEN NOT list_contains(tags, 'NOT_NULL') THEN column_name END, '|' ORDER BY k), '') AS nullable_columns FROM hit GROUP BY schema_id, database""",
)
def table_analysis(spark, sf_dir):
    found = cat.table_analysis(schemas(spark, sf_dir), "events")
    return found.select("schema_id", "database", "total_columns", *[_joined(c).alias(c) for c in found.columns[3:]])


@query(
    "schema_summary",
    f"""WITH {SCHEMAS} SELECT schema_id, 'db' || i AS database, (SELECT count(*) FROM tabs t WHERE t.schema_id = dbs.schema_id AND t.i = dbs.i) AS table_count,
 coalesce((SELECT string_agg(table_name || ':' || n_cols || ':id', '|' ORDER BY j) FROM tabs t WHERE t.schema_id = dbs.schema_id AND t.i = dbs.i), '') AS tables FROM dbs""",
)
def schema_summary(spark, sf_dir):
    line = lambda t: F.concat_ws(":", t["name"], t.column_count.cast("string"), F.array_join(t.primary_keys, ","))
    return cat.summary(schemas(spark, sf_dir)).withColumn("tables", F.array_join(F.transform("tables", line), "|"))


# --- statistics ---------------------------------------------------------------------------------


@query(
    "catalog_stats",
    f"""WITH {SCHEMAS} SELECT count(*) AS total_schemas, (SELECT count(*) FROM dbs) AS total_databases, (SELECT count(*) FROM tabs) AS total_tables,
 (SELECT count(*) FROM attrs) AS total_attributes, sum(file_size)::BIGINT AS total_storage_bytes, round(count(*) / 100 * 100, 6) AS usage_percentage FROM schemas""",
)
def catalog_stats(spark, sf_dir):
    return cat.statistics(schemas(spark, sf_dir)).withColumn("usage_percentage", F.round("usage_percentage", 6))


@query("constraint_dist", f"WITH {SCHEMAS} SELECT constraint_tag, count(*) AS n FROM (SELECT unnest(tags) AS constraint_tag FROM attrs) GROUP BY 1")
def constraint_dist(spark, sf_dir):
    return cat.constraint_distribution(schemas(spark, sf_dir))


@query("type_dist", f"WITH {SCHEMAS} SELECT coalesce(type, 'UNKNOWN') AS data_type, count(*) AS n FROM attrs GROUP BY 1")
def type_dist(spark, sf_dir):
    return cat.type_distribution(schemas(spark, sf_dir))


# --- relational catalogue ----------------------------------------------------------------------

INFO = """info AS (SELECT 't_' || o_custkey AS table_name, 'c_' || o_orderkey AS column_name, o_custkey, o_orderstatus AS s, o_orderpriority AS p,
  CASE o_orderstatus WHEN 'F' THEN 'bigint' WHEN 'O' THEN 'character varying' ELSE 'timestamp' END AS data_type,
  CASE o_orderstatus WHEN 'O' THEN 64 END AS len, CASE WHEN o_orderpriority = '1-URGENT' THEN 'NEXTVAL(''s'')' WHEN o_orderstatus = 'P' THEN 'now()' END AS dflt FROM orders)"""


def _info(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("table_name"),
        F.concat(F.lit("c_"), F.col("o_orderkey").cast("string")).alias("column_name"),
        "o_custkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"),
        F.when(F.col("o_orderstatus") == "F", "bigint").when(F.col("o_orderstatus") == "O", "character varying").otherwise("timestamp").alias("data_type"),
        F.when(F.col("o_orderstatus") == "O", 64).alias("character_maximum_length"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "NEXTVAL('s')").when(F.col("o_orderstatus") == "P", "now()").alias("column_default"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "NO").otherwise("YES").alias("is_nullable"),
    )


@query(
    "catalog_assembly",
    f"""WITH {INFO} SELECT table_name, column_name, upper(data_type) AS type, len::VARCHAR AS type_params, dflt AS default_value,
 concat_ws('|', CASE WHEN p = '2-HIGH' THEN 'NOT_NULL' END, CASE WHEN p = '1-URGENT' THEN 'AUTO_INCREMENT' END,
  CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'PRIMARY_KEY' END, CASE WHEN p = '3-MEDIUM' THEN 'UNIQUE' END,
  CASE WHEN s = 'P' THEN '{FK_TAG}a.id' END, CASE WHEN p = '5-LOW' THEN '{FK_TAG}t_' || (o_custkey + 1) || '.id' END) AS constraints FROM info""",
)
def catalog_assembly(spark, sf_dir):
    info = _info(spark, sf_dir)
    key = ["table_name", "column_name"]
    next_table = F.concat(F.lit("t_"), (F.col("o_custkey") + 1).cast("string"))
    fks = info.filter("p = '5-LOW'").select(*key, next_table.alias("ft"), F.lit("id").alias("fc")).unionByName(
        info.filter("s = 'P'").select(*key, F.lit("a").alias("ft"), F.lit("id").alias("fc"))
    )
    made = cat.assemble(info, info.filter("p in ('1-URGENT', '2-HIGH')").select(*key), info.filter("p = '3-MEDIUM'").select(*key), fks)
    return made.withColumn("constraints", _joined("constraints"))


@query(
    "policy_attach",
    """WITH t AS (SELECT 't_' || c_custkey AS table_name FROM customer), p AS (SELECT 't_' || o_custkey AS table_name, 'p_' || o_orderkey AS policyname,
  o_orderpriority AS cmd, o_orderstatus AS qual FROM orders WHERE o_orderstatus <> 'O')
SELECT table_name, policyname, cmd, qual FROM t LEFT JOIN p USING (table_name)""",
)
def policy_attach(spark, sf_dir):
    named = lambda c: F.concat(F.lit("t_"), F.col(c).cast("string")).alias("table_name")
    policies = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(
        named("o_custkey"), F.concat(F.lit("p_"), F.col("o_orderkey").cast("string")).alias("policyname"),
        F.col("o_orderpriority").alias("cmd"), F.col("o_orderstatus").alias("qual"),
    )
    return cat.attach_policies(table(spark, sf_dir, "customer").select(named("c_custkey")), policies)


# --- types, references, order, roles -----------------------------------------------------------


def _sql_map(table: dict, key: str, default: str) -> str:
    return "CASE " + f"{key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@query(
    "type_normalise",
    f"""WITH raw AS (SELECT ['str', 'int', 'ObjectId', 'Regex', 'Int64', 'bool'][(l_partkey % 6 + 1)::INT] AS doc_type,
  ['String', 'duration', 'Point', 'ZONED_DATE_TIME', 'Vector'][(l_suppkey % 5 + 1)::INT] AS graph_type,
  ['int', 'Varchar', 'NUMERIC', 'date', 'bool', 'json'][(l_orderkey % 6 + 1)::INT] AS sql_type FROM lineitem)
SELECT {_sql_map(typemaps.DOCUMENT, 'doc_type', 'upper(doc_type)')} AS document_type, {_sql_map(typemaps.GRAPH, 'upper(graph_type)', 'upper(graph_type)')} AS graph_type,
 {_sql_map(typemaps.STRATEGY, 'upper(sql_type)', "'string'")} AS strategy, {_sql_map(typemaps.ROLE, 'upper(sql_type)', "'categorical'")} AS role, count(*) AS n
FROM raw GROUP BY ALL""",
)
def type_normalise(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        _at(["str", "int", "ObjectId", "Regex", "Int64", "bool"], F.col("l_partkey")).alias("d"),
        _at(["String", "duration", "Point", "ZONED_DATE_TIME", "Vector"], F.col("l_suppkey")).alias("g"),
        _at(["int", "Varchar", "NUMERIC", "date", "bool", "json"], F.col("l_orderkey")).alias("s"),
    )
    none = F.array().cast("array<string>")
    return raw.groupBy(
        typemaps.document_type(F.col("d")).alias("document_type"), typemaps.graph_type(F.col("g")).alias("graph_type"),
        typemaps.strategy(F.col("s"), none).alias("strategy"), typemaps.role(F.col("s"), none).alias("role"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fk_edges",
    f"""WITH {SCHEMAS} SELECT schema_id, table_name AS child, column_name AS child_column, split_part(replace(tags[1], '{FK_TAG}', ''), '.', 1) AS parent,
 'id' AS parent_column FROM attrs WHERE tags[1] LIKE 'FOREIGN%'""",
)
def fk_edges(spark, sf_dir):
    return cat.fk_edges(cat.flatten(schemas(spark, sf_dir), "schema_id"), "schema_id")


@query(
    "generation_levels",
    f"""WITH RECURSIVE {SCHEMAS}, names AS (SELECT DISTINCT schema_id, table_name FROM tabs),
edges AS (SELECT DISTINCT a.schema_id, a.table_name AS child, n.table_name AS parent FROM attrs a JOIN names n
   ON n.schema_id = a.schema_id AND a.tags[1] = '{FK_TAG}' || n.table_name || '.id' AND n.table_name <> a.table_name),
paths AS (SELECT schema_id, table_name, 0 AS level FROM names UNION ALL
   SELECT p.schema_id, e.child, p.level + 1 FROM paths p JOIN edges e ON e.schema_id = p.schema_id AND e.parent = p.table_name)
SELECT schema_id, table_name, max(level) AS level FROM paths GROUP BY ALL""",
)
def generation_levels(spark, sf_dir):
    return cat.generation_levels(schemas(spark, sf_dir), "schema_id")


@query(
    "column_roles",
    f"""WITH {SCHEMAS} SELECT role, count(*) AS n FROM (SELECT CASE WHEN list_contains(tags, 'PRIMARY_KEY') OR list_contains(tags, 'AUTO_INCREMENT') OR tags[1] LIKE 'FOREIGN%' THEN 'id'
  ELSE {_sql_map(typemaps.ROLE, 'type', "'categorical'")} END AS role FROM attrs) GROUP BY role""",
)
def column_roles(spark, sf_dir):
    roles = cat.column_roles(cat.flatten(schemas(spark, sf_dir), "schema_id"), "schema_id")
    return roles.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("table_primary_keys", f"WITH {SCHEMAS} SELECT schema_id, 'db' || i AS database, table_name, 'id' AS primary_key FROM tabs")
def table_primary_keys(spark, sf_dir):
    return cat.primary_keys(schemas(spark, sf_dir), "schema_id")


# --- lookups and relationships ------------------------------------------------------------------

_FOUND = f"WITH {SCHEMAS} SELECT schema_id, filename, user_id FROM schemas WHERE"


@query("schema_find_by_id", f"{_FOUND} schema_id = 'schema_' || md5('7')")
def schema_find_by_id(spark, sf_dir):
    stored = schemas(spark, sf_dir)
    return cat.find(stored, "schema_id", "schema_" + hashlib.md5(b"7").hexdigest()).select("schema_id", "filename", "user_id")


@query("schema_find_by_hash_owned", f"{_FOUND} content_hash = md5('7') AND user_id = 'en'")
def schema_find_by_hash_owned(spark, sf_dir):
    stored = schemas(spark, sf_dir)
    return cat.find(stored, "content_hash", hashlib.md5(b"7").hexdigest(), "en").select("schema_id", "filename", "user_id")


@query(
    "schema_relationships",
    f"""WITH {SCHEMAS}, refs AS (SELECT schema_id, table_name AS child, column_name AS foreign_key, unnest(tags) AS tag FROM attrs),
edges AS (SELECT schema_id, child, foreign_key, regexp_extract(tag, '^{FK_TAG}(.+)[.]([^.]+)$', 1) AS parent, regexp_extract(tag, '^{FK_TAG}(.+)[.]([^.]+)$', 2) AS parent_key FROM refs)
SELECT schema_id, parent, parent_key, child, foreign_key FROM edges WHERE (schema_id, parent) IN (SELECT (schema_id, table_name) FROM attrs)""",
)
def schema_relationships(spark, sf_dir):
    return cat.relationships(cat.flatten(schemas(spark, sf_dir), "schema_id"), "schema_id")
