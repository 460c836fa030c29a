"""Source, sink, DDL, document and graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mockloom.operators import catalog as cat
from mockloom.operators import ddl, profile
from mockloom.plans.derive import table
from mockloom.plans.registry import query
from mockloom.session import scratch_path
from mockloom.sources import tables as io
from mockloom.sources import text as txt

FK = "FOREIGN_KEY_REFERENCES_"

# --- round trips -----------------------------------------------------------------------


def _round_trip(spark, df, fmt: str, name: str):
    path = io.write_table(df, scratch_path(spark, name), fmt)
    return io.read_table(spark, path, fmt, df.schema if fmt in ("csv", "json") else None)


@query(
    "scan_csv_tables",
    """SELECT table_name, rows, total FROM (SELECT 'orders' AS table_name, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders
 UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2) FROM customer)""",
)
def scan_csv_tables(spark, sf_dir):
    folder = scratch_path(spark, "csv-set")
    sums = {"orders": "o_totalprice", "customer": "c_acctbal", "part": "p_retailprice"}
    sets = {t: table(spark, sf_dir, t) for t in sums}
    io.write_set(sets, folder)
    for t in ("orders", "customer"):
        io.write_table(sets[t], f"{folder}/{t}_synthetic.csv")
    real = io.read_csv_set(spark, folder, {t: df.schema for t, df in sets.items()})
    synth = io.read_csv_set(spark, folder, {t: sets[t].schema for t in ("orders", "customer")}, synthetic=True)
    parts = [
        synth[t].agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(sums[t]), 2).alias("total")).select(F.lit(t).alias("table_name"), "rows", "total")
        for t in io.common_tables(real, synth)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("sink_csv_roundtrip", "SELECT * FROM customer")
def sink_csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "customer"), "csv", "csv")


@query("sink_parquet_roundtrip", "SELECT * FROM orders")
def sink_parquet_roundtrip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "orders"), "parquet", "parquet")


@query("sink_json_roundtrip", "SELECT * FROM part")
def sink_json_roundtrip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "part"), "json", "json")


@query("sink_orc_roundtrip", "SELECT * FROM supplier")
def sink_orc_roundtrip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "supplier"), "orc", "orc")


@query("sink_partitioned", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sink_partitioned(spark, sf_dir):
    path = io.write_table(table(spark, sf_dir, "orders"), scratch_path(spark, "by-status"), "parquet", ["o_orderstatus"])
    back = io.read_table(spark, path, "parquet")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_NOTES = "SELECT o_orderstatus AS name, o_orderstatus || ' ' || count(*) AS value FROM orders GROUP BY o_orderstatus"


def _note_files(spark, sf_dir, name):
    """One text file of known content for every order status, in a folder of its own."""
    path = scratch_path(spark, name)
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    notes = counts.select(F.col("o_orderstatus").alias("status"), F.concat_ws(" ", "o_orderstatus", "n").alias("value"))
    notes.coalesce(1).write.partitionBy("status").text(path)
    return path


@query("file_inventory", f"SELECT '.txt' AS extension, octet_length(encode(value || chr(10))) AS size, md5(value || chr(10)) AS hash FROM ({_NOTES})")
def file_inventory(spark, sf_dir):
    files = io.file_inventory(spark, _note_files(spark, sf_dir, "inventory"), "*.txt", recursive=True)
    return files.select("extension", "size", "hash")


@query(
    "storage_stats",
    f"""WITH n AS (SELECT sum(octet_length(encode(value)) + 1)::BIGINT AS size, count(*) AS files FROM ({_NOTES}))
SELECT 'seed_data' AS directory, size, files FROM n UNION ALL SELECT 'synthetic_data', size, files FROM n UNION ALL SELECT '*', 2 * size, 2 * files FROM n""",
)
def storage_stats(spark, sf_dir):
    return io.storage_stats(spark, {d: _note_files(spark, sf_dir, d) for d in ("seed_data", "synthetic_data")})


@query("ddl_refused", f"SELECT octet_length(encode(value)) + 1 AS length, 'larger than 5 bytes' AS reason FROM ({_NOTES}) WHERE octet_length(encode(value)) + 1 > 5")
def ddl_refused(spark, sf_dir):
    path = _note_files(spark, sf_dir, "ddl")
    return txt.refused_ddl(spark, f"{path}/*", 5, ".txt").select("length", "reason")


@query("report_sink", "SELECT o_orderstatus AS column_name, 'rows' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def report_sink(spark, sf_dir):
    report = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("column_name")).agg(
        F.lit("rows").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")
    )
    path = io.write_report(report, scratch_path(spark, "report"))
    return io.read_json_column(spark, path, "column_name string, metric string, value double")


# --- payloads -----------------------------------------------------------------------------


def _payloads(spark, sf_dir):
    kind = F.col("event_type")
    listed = F.concat(F.lit("[" ), F.col("props"), F.lit(', {"k": "x", "t": "'), kind, F.lit('"}]'))
    raw = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), listed, F.lit("\n```\n")))
        .when(kind == "view", F.concat(F.lit("  ```\n"), listed, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Sorry: "), listed))
        .when(kind == "signup", F.col("props"))  # an object, not a list
        .otherwise(listed)
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(
    "payload_rows",
    """SELECT event_id, p::INT AS position, CASE p WHEN 0 THEN json_extract_string(props, '$.k') ELSE 'x' END AS k,
 CASE p WHEN 1 THEN event_type END AS t FROM events, (VALUES (0), (1)) AS v(p) WHERE event_type IN ('click', 'view', 'purchase')""",
)
def payload_rows(spark, sf_dir):
    rows = txt.payload_rows(_payloads(spark, sf_dir), "raw", "event_id")
    at = lambda k: F.try_element_at("row", F.lit(k)).alias(k)
    return rows.select("event_id", "position", at("k"), at("t"))


@query("payload_rejects", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")
def payload_rejects(spark, sf_dir):
    return txt.payload_rejects(_payloads(spark, sf_dir), "raw").select("event_id")


# --- DDL ------------------------------------------------------------------------------------


def _ddl(spark, sf_dir):
    """One DDL file per part, with every construct the reader knows."""
    p = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("-- catalogue of "), F.col("p_name"), F.lit("\nUSE `shop_"), (F.col("p_size") % 3).cast("string"), F.lit("`;\n"),
        F.lit("CREATE TABLE IF NOT EXISTS users_"), p,
        F.lit(" (\n  `id` BIGINT NOT NULL AUTO_INCREMENT, # surrogate\n  email VARCHAR(255) UNIQUE DEFAULT 'a;b,(C',\n"
              "  amount DECIMAL(10, 2) DEFAULT 0.5,\n  PRIMARY KEY (`id`, email)\n);\n/* a\n block; */\nCREATE TABLE db_"),
        (F.col("p_size") % 2).cast("string"),
        F.lit(".posts (\n id INT PRIMARY KEY,\n user_id BIGINT NOT NULL,\n kind ENUM('x','y') default 'x',\n a INT, b INT REFERENCES kinds(id),\n"
              " keyword TEXT,\n CHECK (a IN (1,(2,3))),\n CONSTRAINT fk_u FOREIGN KEY (user_id) REFERENCES users_"), p,
        F.lit("(id),\n FOREIGN KEY (a, b) REFERENCES pairs (x, y),\n FOREIGN KEY (`user_id`) REFERENCES `owners` (`id`),\n INDEX idx_u (user_id),\n KEY k2 (kind)\n)"),
        F.when(F.col("p_size") % 2 == 0, ";\n").otherwise(""),
    )
    return table(spark, sf_dir, "part").select(p.alias("path"), text.alias("value"))


def _ddl_sql(users: list[tuple], posts: list[tuple]) -> str:
    def rows(listed, name, database, position):
        return " UNION ALL ".join(
            f"SELECT p_partkey::VARCHAR AS path, {position} AS position, {database} AS database, {name} AS table_name, {i} AS ordinal, "
            f"'{n}' AS column_name, '{t}' AS type, {'NULL' if a is None else a} AS type_params, {'NULL' if d is None else d} AS default_value, {c} AS constraints FROM part"
            for i, (n, t, a, d, c) in enumerate(listed)
        )

    return rows(users, "'users_' || p_partkey", "'shop_' || (p_size % 3)", 1) + " UNION ALL " + rows(posts, "'posts'", "'db_' || (p_size % 2)", 2)


USERS_LINK = f"'{FK}users_' || p_partkey || '.id'"


@query(
    "ddl_attributes",
    _ddl_sql(
        [("id", "BIGINT", None, None, "'NOT_NULL|AUTO_INCREMENT|PRIMARY_KEY'"),
         ("email", "VARCHAR", "'255'", "'''a;b,(C'''", "'UNIQUE|PRIMARY_KEY'"),
         ("amount", "DECIMAL", "'10,2'", "'0.5'", "''")],
        [("id", "INT", None, None, "'PRIMARY_KEY'"),
         ("user_id", "BIGINT", None, None, f"'NOT_NULL|' || {USERS_LINK} || '|{FK}owners.id'"),
         ("kind", "ENUM", "'''x'',''y'''", "'''x'''", "''"),
         ("a", "INT", None, None, f"'{FK}pairs.x'"),
         ("b", "INT", None, None, f"'{FK}kinds.id|{FK}pairs.y'"),
         ("keyword", "TEXT", None, None, "''")],
    ),
)
def ddl_attributes(spark, sf_dir):
    return ddl.attributes(_ddl(spark, sf_dir)).withColumn("constraints", F.concat_ws("|", "constraints"))


@query(
    "ddl_attributes_strict",
    _ddl_sql(
        [("id", "BIGINT", None, None, "'NOT_NULL|AUTO_INCREMENT|PRIMARY_KEY'"),
         ("email", "VARCHAR", "'255'", "'''A;B'", "'UNIQUE|PRIMARY_KEY'"),
         ("amount", "DECIMAL(10,", None, "'0.5'", "''")],
        [("id", "INT", None, None, "''"),
         ("user_id", "BIGINT", None, None, f"'NOT_NULL|{FK}owners.id'"),
         ("kind", "ENUM", "'''x'',''y'''", "'''X'''", "''"),
         ("a", "INT", None, None, "''"),
         ("b", "INT", None, None, "''"),
         ("CHECK", "(A", None, None, "''")],
    ),
)
def ddl_attributes_strict(spark, sf_dir):
    return ddl.attributes(_ddl(spark, sf_dir), strict=True).withColumn("constraints", F.concat_ws("|", "constraints"))


@query(
    "ddl_databases",
    "SELECT p_partkey::VARCHAR AS path, unnest(['shop_' || (p_size % 3), 'db_' || (p_size % 2)]) AS database FROM part",
)
def ddl_databases(spark, sf_dir):
    return ddl.databases(_ddl(spark, sf_dir))


@query("scan_ddl_corpus", "SELECT 2 * count(*) AS tables, count(DISTINCT p_size % 2) + count(DISTINCT p_size % 3) AS databases FROM part")
def scan_ddl_corpus(spark, sf_dir):
    path = scratch_path(spark, "ddl")
    # files stay below the size limit whatever the table size
    corpus = _ddl(spark, sf_dir).select(F.concat("value", F.when(~F.col("value").endswith(";\n"), ";").otherwise("")).alias("value"))
    corpus.write.option("maxRecordsPerFile", 10_000).text(path)
    found = ddl.attributes(txt.read_ddl(spark, path, extension=".txt"))
    return found.filter("ordinal = 0").agg(F.count(F.lit(1)).alias("tables"), F.count_distinct("database").alias("databases"))


# --- documents ---------------------------------------------------------------------------------


def _docs(spark, sf_dir):
    kind = F.col("event_type")
    value = F.when(kind == "click", F.lit('"n/a"')).when(kind == "view", F.lit("null")).otherwise(F.col("value").cast("string"))
    nested = F.when(
        kind.isin("purchase", "signup"),
        F.concat(F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"a":{"b":{"c":{"d":{"e":1}},"x":true}}}')),
    ).otherwise(F.lit(""))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit('{"_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit(',"value":'), value, nested,
            F.lit(',"tags":[1,{"z":2}],"empty":{}}'),
        ).alias("doc"),
    )


DOCS = """docs AS (SELECT event_id, '{"_id":' || event_id || ',"props":' || props || ',"value":' ||
 CASE event_type WHEN 'click' THEN '"n/a"' WHEN 'view' THEN 'null' ELSE value::VARCHAR END ||
 CASE WHEN event_type IN ('purchase', 'signup') THEN ',"user":{"id":' || user_id || ',"a":{"b":{"c":{"d":{"e":1}},"x":true}}}' ELSE '' END ||
 ',"tags":[1,{"z":2}],"empty":{}}' AS doc FROM events)"""
_next = lambda i: f"""l{i} AS (SELECT path || '.' || k AS path, json_extract(v, '$."' || k || '"') AS v FROM
 (SELECT path, v, unnest(json_keys(v)) AS k FROM l{i - 1} WHERE json_type(v) = 'OBJECT'))"""
INFER = f"""{DOCS}, l1 AS (SELECT k AS path, json_extract(doc, '$."' || k || '"') AS v FROM (SELECT doc::JSON AS doc, unnest(json_keys(doc)) AS k FROM docs)),
{_next(2)}, {_next(3)}, {_next(4)}, {_next(5)},
every AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4 UNION ALL SELECT * FROM l5),
typed AS (SELECT path, CASE json_type(v) WHEN 'VARCHAR' THEN 'VARCHAR' WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'DOUBLE'
  WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'OBJECT' THEN 'JSON' ELSE 'NULL' END AS type, count(*) AS n FROM every GROUP BY ALL),
fields AS (SELECT path AS column_name, arg_max(type, n * 1000 + ascii(type)) AS type, sum(n)::BIGINT AS seen FROM typed GROUP BY path)"""
TAGS = """concat_ws('|', CASE WHEN column_name = '_id' THEN 'PRIMARY_KEY' END,
 CASE WHEN seen < (SELECT count(*) FROM events) THEN 'NULLABLE' ELSE 'NOT_NULL' END)"""


@query("doc_infer_schema", f"WITH {INFER} SELECT column_name, type, seen, {TAGS} AS constraints FROM fields")
def doc_infer_schema(spark, sf_dir):
    return profile.infer_documents(_docs(spark, sf_dir), "doc").withColumn("constraints", F.concat_ws("|", "constraints"))


@query(
    "doc_indexes",
    f"""WITH {INFER} SELECT column_name, type, {TAGS} || CASE column_name WHEN 'value' THEN '|INDEXED' WHEN 'user.id' THEN '|UNIQUE|INDEXED' ELSE '' END AS constraints FROM fields""",
)
def doc_indexes(spark, sf_dir):
    found = profile.infer_documents(_docs(spark, sf_dir), "doc").drop("seen")
    indexes = spark.createDataFrame(
        [("_id_", "_id", False), ("by_value", "value", False), ("by_value_user", "value", False), ("by_user", "user.id", True), ("gone", "gone", True)],
        "index_name string, key string, unique boolean",
    )
    return cat.apply_indexes(found, indexes).withColumn("constraints", F.concat_ws("|", "constraints"))


@query("doc_sample", f"WITH {DOCS} SELECT event_id, doc FROM docs ORDER BY event_id LIMIT 100")
def doc_sample(spark, sf_dir):
    return profile.sample(_docs(spark, sf_dir), "event_id", 100)


@query(
    "doc_collections",
    """SELECT database, collection, count(*) AS n FROM (SELECT CASE WHEN lang = 'fr' THEN 'admin' ELSE lang END AS database,
  CASE WHEN source = 'src1' THEN 'system.' || source ELSE source END AS collection FROM documents)
 WHERE database <> 'admin' AND collection NOT LIKE 'system.%' GROUP BY ALL""",
)
def doc_collections(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "fr", "admin").otherwise(F.col("lang")).alias("database"),
        F.when(F.col("source") == "src1", F.concat(F.lit("system."), "source")).otherwise(F.col("source")).alias("collection"),
    )
    return profile.user_collections(named).groupBy("database", "collection").agg(F.count(F.lit(1)).alias("n"))


# --- graph ------------------------------------------------------------------------------------------


def _graph(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    vid = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    props = lambda *cols: F.to_variant_object(F.struct(*cols)).alias("props")
    node = lambda df, kind, key, labels, *cols: df.select(vid(kind, key).alias("id"), labels.alias("labels"), props(*cols))
    one = lambda label: F.array(F.lit(label))
    customer_labels = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Customer"), F.lit("Builder"))).when(
        F.col("c_mktsegment") == "MACHINERY", F.array().cast("array<string>")
    ).otherwise(one("Customer"))
    nodes = (
        node(t("region"), "region", "r_regionkey", one("Region"), "r_name")
        .unionByName(node(t("nation"), "nation", "n_nationkey", one("Nation"), "n_name", "n_nationkey"))
        .unionByName(node(t("customer"), "customer", "c_custkey", customer_labels, "c_name", "c_acctbal"))
        .unionByName(node(t("orders"), "order", "o_orderkey", one("Order"), "o_orderkey", "o_totalprice", "o_orderdate"))
    )
    edge = lambda df, kind, a, ak, b, bk, *cols: df.select(
        vid(a, ak).alias("src"), vid(b, bk).alias("dst"), F.lit(kind).alias("type"), (props(*cols) if cols else F.parse_json(F.lit("{}")).alias("props"))
    )
    edges = (
        edge(t("nation"), "IN", "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(edge(t("customer"), "LIVES_IN", "customer", "c_custkey", "nation", "c_nationkey", "c_mktsegment"))
        .unionByName(edge(t("orders"), "PLACED_BY", "order", "o_orderkey", "customer", "o_custkey", "o_orderpriority", "o_orderstatus"))
        .unionByName(edge(t("orders"), "FOLLOWS", "customer", "o_custkey", "customer", "o_custkey"))
    )
    return nodes, edges


@query(
    "graph_nodes",
    """SELECT * FROM (VALUES ('Region', 'r_name', 'VARCHAR', ''), ('Nation', 'n_name', 'VARCHAR', 'UNIQUE'), ('Nation', 'n_nationkey', 'INTEGER', 'NOT_NULL|UNIQUE'),
 ('Customer', 'c_name', 'VARCHAR', ''), ('Customer', 'c_acctbal', 'DOUBLE', 'NOT_NULL'), ('Builder', 'c_name', 'VARCHAR', ''), ('Builder', 'c_acctbal', 'DOUBLE', ''),
 ('Order', 'o_orderkey', 'INTEGER', ''), ('Order', 'o_totalprice', 'DOUBLE', ''), ('Order', 'o_orderdate', 'TIMESTAMP', '')) AS v(label, "key", type, constraints)""",
)
def graph_nodes(spark, sf_dir):
    declared = spark.createDataFrame(
        [("Nation", "n_name", "UNIQUENESS"), ("Nation", "n_nationkey", "UNIQUENESS"), ("Nation", "n_nationkey", "NODE_PROPERTY_EXISTENCE"),
         ("Customer", "c_acctbal", "not null")],
        "label string, key string, type string",
    )
    found = profile.node_attributes(_graph(spark, sf_dir)[0], declared)
    return found.withColumn("constraints", F.concat_ws("|", "constraints"))


@query(
    "graph_node_counts",
    """SELECT 'Region' AS label, count(*) AS node_count FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Order', count(*) FROM orders
 UNION ALL SELECT 'Builder', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'Customer', count(*) FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def graph_node_counts(spark, sf_dir):
    return profile.node_counts(_graph(spark, sf_dir)[0])


_LABELS = "CASE c_mktsegment WHEN 'MACHINERY' THEN NULL ELSE 'Customer' END"


@query(
    "graph_node_rels",
    f"""WITH c AS (SELECT o_orderkey, c_mktsegment, coalesce({_LABELS}, 'Unknown') AS target FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT 'Nation' AS label, 'IN' AS type, 'Region' AS target FROM nation UNION SELECT 'Customer', 'LIVES_IN', 'Nation' FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION SELECT 'Builder', 'LIVES_IN', 'Nation' FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'Order', 'PLACED_BY', target FROM c
UNION SELECT 'Customer', 'FOLLOWS', target FROM c WHERE c_mktsegment <> 'MACHINERY' UNION SELECT 'Builder', 'FOLLOWS', target FROM c WHERE c_mktsegment = 'BUILDING'""",
)
def graph_node_rels(spark, sf_dir):
    return profile.node_relations(*_graph(spark, sf_dir))


@query(
    "graph_rel_pairs",
    f"""WITH c AS (SELECT {_LABELS} AS l FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT 'IN' AS type, 'Nation' AS source, 'Region' AS target FROM nation UNION SELECT 'LIVES_IN', {_LABELS}, 'Nation' FROM customer
UNION SELECT 'PLACED_BY', 'Order', l FROM c UNION SELECT 'FOLLOWS', l, l FROM c""",
)
def graph_rel_pairs(spark, sf_dir):
    return profile.relationship_pairs(*_graph(spark, sf_dir))


@query(
    "graph_rels",
    """SELECT 'IN' AS type, count(*) AS relationship_count, '' AS keys FROM nation UNION ALL SELECT 'LIVES_IN', count(*), 'c_mktsegment' FROM customer
 UNION ALL SELECT 'PLACED_BY', count(*), 'o_orderpriority|o_orderstatus' FROM orders UNION ALL SELECT 'FOLLOWS', count(*), '' FROM orders""",
)
def graph_rels(spark, sf_dir):
    return profile.relationship_profile(_graph(spark, sf_dir)[1]).withColumn("keys", F.concat_ws("|", "keys"))


@query(
    "graph_totals",
    """SELECT 'nodes' AS kind, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n
 UNION ALL SELECT 'relationships', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM orders)""",
)
def graph_totals(spark, sf_dir):
    return profile.totals(*_graph(spark, sf_dir))
