"""Fixed values, invariants, skew helpers against brute force, and plan checks."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mockloom.functions.rng import u32
from mockloom.functions.tests_math import chi2_pvalue, ks_pvalue
from mockloom.operators import catalog, copula, ddl, fidelity, generate, nearest, privacy, profile, scan
from mockloom.plans.catalog_queries import schemas
from mockloom.sources import tables as io
from mockloom.sources import text as txt
from mockloom.sources.schema_json import is_valid, read_schema_files
from mockloom.streaming import jobs as streams

SF_DIR = "/root/testdata/sf0.001"
FK = "FOREIGN_KEY_REFERENCES_"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- fixed values ----------------------------------------------------------------------


def test_round_trip_two_rows(spark, tmp_path):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id bigint, name string")
    paths = io.write_set({"users": users}, str(tmp_path))
    assert len(paths) == 1
    back = io.read_table(spark, paths["users"], "csv", users.schema)
    assert back.count() == 2 and "name" in back.columns


def test_generation_order_either_spelling():
    table = lambda name, *attributes: {"name": name, "attributes": [{"name": n, "constraints": c} for n, c in attributes]}
    doc = {"databases": [{"tables": [
        table("posts", ("user_id", ["FOREIGN KEY REFERENCES users(id)"])), table("users", ("id", ["PRIMARY KEY"])),
    ]}]}
    assert generate.generation_order(doc) == ["users", "posts"]


def test_tvd_third(spark):
    side = lambda text: spark.createDataFrame([(c,) for c in text], "c string")
    assert fidelity.tvd(side("AAB"), side("ABB"), ["c"]).first()["tvd"] == pytest.approx(1 / 3)


def test_counter_anchor(spark):
    assert spark.range(7, 8).select(u32("42", "orders", "id", F.col("id"))).first()[0] == 2644465909


def test_parity_pair_anchors(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    even, odd = (orders.filter(F.col("o_orderkey") % 2 == r) for r in (0, 1))
    assert fidelity.ks_statistic(even, odd, ["o_totalprice"]).first()["statistic"] == pytest.approx(0.012933333333333352, abs=1e-15)
    assert fidelity.tvd(even, odd, ["o_orderstatus"]).first()["tvd"] == pytest.approx(0.013333333333333336, abs=1e-15)
    tested = fidelity.chi_square_test(even.select("o_orderstatus"), odd.select("o_orderstatus")).first()
    assert tested["chi2_statistic"] == pytest.approx(3.4076050114621284)
    assert tested["p_value"] == pytest.approx(0.18199018794822375)


def test_tail_probabilities(spark):
    one = spark.range(1)
    lam = one.select(ks_pvalue(F.lit(0.8), F.lit(2), F.lit(2))).first()[0]  # sqrt(nm/(n+m)) = 1
    assert lam == pytest.approx(0.5441424115741982)
    p = one.select(*[chi2_pvalue(F.lit(x), F.lit(k)) for x, k in ((3.841458820694124, 1.0), (5.991464547107979, 2.0), (11.070497693516351, 5.0), (150.0, 100.0))]).first()
    assert p[0] == pytest.approx(0.05) and p[1] == pytest.approx(0.05) and p[2] == pytest.approx(0.05)
    # 100 degrees of freedom: the finite sum exp(-75) * sum 75**i / i!
    assert p[3] == pytest.approx(math.fsum(math.exp(i * math.log(75) - math.lgamma(i + 1) - 75) for i in range(50)), rel=1e-9)


def test_two_categories_get_the_correction(spark):
    side = lambda a, b: spark.createDataFrame([("a",)] * a + [("b",)] * b, "c string")
    got = fidelity.chi_square(side(10, 20), side(20, 10), csv_semantics=True).first()
    assert got["chi2_statistic"] == pytest.approx(4 * 4.5**2 / 15)


# --- invariants --------------------------------------------------------------------------


def test_identical_tables_score_one(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderstatus")
    assert all(r["score"] == 0 and r["overall_score"] == 1 for r in fidelity.audit_quality(orders, orders).collect())
    assert fidelity.quality_score(orders, orders).first()["overall_score"] == pytest.approx(1.0)
    leak = privacy.leakage_rate(orders, orders).first()
    assert leak["shared_rows"] == orders.distinct().count()
    assert all(r["distance"] == 0 for r in nearest.closest(orders, orders, ["o_custkey", "o_totalprice"]).collect())


def test_number_against_text_is_full_distance(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    right = spark.createDataFrame([("1", "x")], "a string, b string")
    got = {r["column_name"]: r["score"] for r in fidelity.audit_quality(left, right).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_one_numeric_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError):
        fidelity.correlation_preservation(df, df)


def test_null_rows_leak_and_empty_side(spark):
    left = spark.createDataFrame([(None, 1), (None, 1), (2, 2)], "a int, b int")
    right = spark.createDataFrame([(None, 1), (3, 3)], "a int, b int")
    assert privacy.leakage_rate(left, right).first()["leakage_rate"] == 0.5
    assert privacy.leakage_rate(left, right.limit(0)).first()["leakage_rate"] == 0


def test_generation_does_not_depend_on_partitions(spark):
    doc = {"databases": [{"tables": [{"name": "t", "attributes": [
        {"name": "id", "type": "BIGINT", "constraints": ["PRIMARY_KEY"]}, {"name": "email", "type": "VARCHAR"},
        {"name": "made", "type": "DATETIME"}, {"name": "odd", "type": "UUID"}]}]}]}
    made = generate.TableSet(spark, doc, {"t": 500})
    assert rows(made.table("t", 1).orderBy("id")) == rows(made.table("t", 16).orderBy("id"))
    assert rows(generate.TableSet(spark, doc, {"t": 500}, seed=1).table("t", 1)) != rows(made.table("t", 1))


def test_custom_generator_cycle_and_self_reference(spark):
    doc = {"databases": [{"tables": [
        {"name": "a", "attributes": [{"name": "id", "type": "INT", "constraints": ["PRIMARY_KEY"]}, {"name": "b_id", "type": "INT", "constraints": [FK + "b.id"]},
                                     {"name": "up", "type": "INT", "constraints": [FK + "a.id"]}]},
        {"name": "b", "attributes": [{"name": "id", "type": "INT", "constraints": ["PRIMARY_KEY"]}, {"name": "a_id", "type": "INT", "constraints": [FK + "a.id"]},
                                     {"name": "note", "type": "TEXT"}]}]}]}
    assert generate.generation_order(doc) == ["a", "b"]
    made = generate.TableSet(spark, doc, {"a": 50, "b": 70}, custom={"b.note": lambda row: F.concat(F.lit("n"), row.cast("string"))})
    assert made.table("b").filter(F.col("note") != F.concat(F.lit("n"), F.col("id").cast("string"))).count() == 0
    assert made.table("a").filter("up not between 1 and 50 or b_id not between 1 and 70").count() == 0


def test_every_listed_field_is_made(spark):
    d = generate.Draws(1, "t", "c", F.col("id"))
    listed = ["first_name", "email", "street_address", "postal_code", "company_name", "credit_card", "timestamp", "paragraph", "ipv6", "percentage"]
    assert spark.range(3).select(*[generate.field_value(f, d).alias(f) for f in listed]).dropna().count() == 3
    with pytest.raises(ValueError):
        generate.field_value("shoe_size", d)


# --- skew helpers against brute force -------------------------------------------------------


def test_running_totals_with_hot_group(spark):
    rng = random.Random(3)
    data = {("hot", float(v)): rng.randint(0, 5) for v in rng.sample(range(10_000), 3000)} | {("cold", 1.5): 2}
    df = spark.createDataFrame([(g, v, n, 1) for (g, v), n in data.items()], "g string, v double, n bigint, m bigint")
    got = {(r["g"], r["v"]): r for r in scan.running_totals(df, "g", "v", ["n", "m"]).collect()}
    assert len(got) == len(data)
    total = 0
    for key in sorted(k for k in data if k[0] == "hot"):
        total += data[key]
        assert got[key]["cum_n"] == total
    assert got[("hot", max(v for g, v in data if g == "hot"))]["all_n"] == total


def test_dense_index_and_neighbours(spark):
    values = [(i % 3, i * 7 % 101, i) for i in range(2000)]
    df = spark.createDataFrame(values, "k int, t int, id int").repartition(5)
    indexed = scan.dense_index(df, ["t", "id"], "n")
    assert [r["n"] for r in indexed.orderBy("t", "id").collect()] == list(range(2000))
    hot = spark.createDataFrame([(0, i, i) for i in range(2000)] + [(1, 5, 5)], "k int, t int, id int").repartition(7)
    got = {(r["k"], r["id"]): (r["b"], r["a"]) for r in scan.with_neighbours(hot, ["k"], ["t", "id"], "id", "b", "a").collect()}
    assert len(got) == 2001 and got[(1, 5)] == (None, None)
    assert all(got[(0, i)] == (i - 1 if i else None, i + 1 if i < 1999 else None) for i in range(2000))


def test_lookup_keeps_hot_and_cold_rows(spark):
    df = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"c{i}", i) for i in range(3000)] + [("gone", 1)], "k string, i int")
    per_key = df.filter("k <> 'gone'").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = scan.lookup_by_key(df, per_key, ["k"])
    assert got.count() == 8000 and got.filter("v <> upper(k)").count() == 0


def test_k_anonymity_with_null_and_hot_group(spark):
    df = spark.createDataFrame([("hot", i) for i in range(5000)] + [(None, i) for i in range(3)] + [("few", 1)] + [(f"g{i % 500}", i) for i in range(1500)], "q string, i int")
    got = dict(rows(privacy.k_anonymity(df, 3, ["q"]).groupBy("q").count()))
    assert got["hot"] == 5000 and got[None] == 3 and "few" not in got and sum(got.values()) == 6503


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_closest_record_is_exact(spark, threshold, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rng = random.Random(5)
    cluster = [(0.5 + rng.random() * 1e-6, 0.5 + rng.random() * 1e-6, rng.random()) for _ in range(400)]
    real = cluster + [(rng.random(), rng.random(), rng.random()) for _ in range(300)] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)] + [cluster[0]] * 200
    synth = cluster[:5] + [(rng.random(), rng.random(), rng.random()) for _ in range(60)] + [(0.5, 0.5, 0.5)] * 30
    frame = lambda pts: spark.createDataFrame(pts, "a double, b double, c double")
    bounds = [(0.0, 1.0)] * 3
    got = {(r["x0"], r["x1"], r["x2"]): r for r in nearest.closest(frame(real), frame(synth), ["a", "b", "c"], bounds).collect()}
    assert len(got) == len(set(synth)) and got[(0.5, 0.5, 0.5)]["weight"] == 30
    for q in set(synth):
        assert got[q]["distance"] == pytest.approx(min(math.dist(q, p) for p in real), abs=1e-12)


# --- catalogue, DDL, documents -----------------------------------------------------------------


def test_levels_with_cycle_and_unknown_parent(spark):
    doc = ('{"databases":[{"name":"d","tables":[{"name":"x","attributes":[{"name":"y_id","constraints":["%sy.id"]}]},'
           '{"name":"y","attributes":[{"name":"x_id","constraints":["%sx.id"]},{"name":"g","constraints":["%sgone.id"]}]},'
           '{"name":"z","attributes":[{"name":"y_id","constraints":["FOREIGN KEY REFERENCES y(id)"]}]}]}]}') % (FK, FK, FK)
    from mockloom.sources.schema_json import parse_payload

    df = spark.createDataFrame([("s", doc)], "schema_id string, payload string").withColumn("databases", parse_payload(F.col("payload")))
    assert dict(rows(catalog.generation_levels(df))) == {"x": 0, "y": 1, "z": 2}


def test_retention_below_cap_keeps_all(spark):
    stored = schemas(spark, SF_DIR)
    assert catalog.retention(stored, cap=10**6).count() == stored.count()
    assert catalog.retention(stored, cap=100).count() == stored.count() - stored.count() // 5


def test_schema_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema": {"databases": [{"name": "d", "tables": [{"name": "t", "attributes": []}]}]}}')
    (tmp_path / "b.json").write_text("broken")
    got = {r["filename"]: r["databases"] for r in read_schema_files(spark, str(tmp_path)).collect()}
    assert got["a.json"][0]["tables"][0]["name"] == "t" and got["b.json"] is None


@pytest.mark.parametrize("payload,valid", [
    ('{"databases": []}', True), ("[]", False), ('{"databases": [{"name": "d", "tables": [{"x": 1}]}]}', False), ("nope", False), ('{"databases": [{"name": "d"}]}', True),
])
def test_document_check(spark, payload, valid):
    assert spark.range(1).select(is_valid(F.lit(payload))).first()[0] is valid


DDL = """CREATE DATABASE IF NOT EXISTS `shop`;
USE shop; CREATE TABLE a (id INT NOT NULL, note VARCHAR(20) DEFAULT '-- no; comment', key_code INT, `key` INT) -- tail
;
CREATE TABLE other.b (x INT, y INT, PRIMARY KEY (`x`, y), CONSTRAINT c FOREIGN KEY (x, y) REFERENCES a (id, key_code));
CREATE TABLE nothing"""


def test_ddl_edges(spark):
    corpus = spark.createDataFrame([("f", DDL)], "path string, value string")
    got = {(r["database"], r["table_name"], r["column_name"]): r for r in ddl.attributes(corpus).collect()}
    assert got[("shop", "a", "note")]["default_value"] == "'-- no; comment'"
    assert ("shop", "a", "key_code") in got
    assert got[("other", "b", "y")]["constraints"] == ["PRIMARY_KEY", FK + "a.key_code"]
    # read strictly, the comment mark cuts the string open and the rest is one USE statement
    assert ddl.attributes(corpus, strict=True).count() == 0
    plain = spark.createDataFrame([("p", "CREATE TABLE b (x INT, key_code INT, y INT, PRIMARY KEY (x), FOREIGN KEY (x, y) REFERENCES a (p, q));")], "path string, value string")
    strict = {r["column_name"]: r["constraints"] for r in ddl.attributes(plain, strict=True).collect()}
    assert strict == {"x": ["PRIMARY_KEY"], "y": []}
    assert {r["database"] for r in ddl.databases(corpus).collect()} == {"shop", "other"}
    empty = spark.createDataFrame([("e", "SELECT 1;")], "path string, value string")
    assert rows(ddl.databases(empty)) == [("e", "default")]


def test_ddl_files(spark, tmp_path):
    (tmp_path / "latin.sql").write_bytes("CREATE TABLE t (n VARCHAR(5) DEFAULT 'é');".encode("latin-1"))
    (tmp_path / "utf.sql").write_text("CREATE TABLE t (n VARCHAR(5) DEFAULT 'ü');", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("CREATE TABLE u (n INT);")
    got = ddl.attributes(txt.read_ddl(spark, str(tmp_path)))
    assert sorted(r["default_value"] for r in got.collect()) == ["'é'", "'ü'"]
    assert txt.read_ddl(spark, str(tmp_path), max_bytes=10).count() == 0


def test_document_depth_and_empty(spark):
    docs = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"n":null}',), ('{"n":1.5}',)], "doc string")
    got = {r["column_name"]: (r["type"], r["constraints"]) for r in profile.infer_documents(docs, "doc").collect()}
    assert "a.b.c.d.e" in got and "a.b.c.d.e.f" not in got
    assert got["n"] == ("NULL", ["NOT_NULL"]) and got["a"] == ("JSON", ["NULLABLE"])
    assert profile.infer_documents(docs.limit(0), "doc").count() == 0
    with pytest.raises(ValueError):
        profile.sample(docs, "doc", 0)


# --- privacy, models, files, streams --------------------------------------------------------------


def test_encryption(spark):
    df = spark.createDataFrame([("secret", None)], "a string, b string")
    key = spark.createDataFrame([("k" * 32,)], "key string")
    locked = privacy.encrypt_columns(df, {"a": "AES-256", "b": "AES-128"}, key)
    assert locked.first()["a"] != "secret"
    assert "kkkkkkkk" not in locked._jdf.queryExecution().toString()
    assert rows(privacy.decrypt_columns(locked, {"a": "AES-256", "b": "AES-128"}, key)) == [("secret", None)]
    with pytest.raises(ValueError):
        privacy.encrypt_columns(df, {"a": "Twofish"}, key)


def test_encryption_gives_published_vectors(spark):
    # ECB example vectors of NIST SP 800-38A, F.1.1 and F.1.5, key and text as bytes (fixed values)
    text = "6bc1bee22e409f96e93d7e117393172a"
    vectors = {"AES-128": ("2b7e151628aed2a6abf7158809cf4f3c", "3ad77bb40d7a3660a89ecaf32466ef97"),
               "AES-256": ("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "f3eed1bdb5d2a03c064b5a7e3db181f8")}
    for algorithm, (key, locked) in vectors.items():
        row = spark.range(1).select(F.unhex(F.lit(text)).alias("t"), F.unhex(F.lit(key)).alias("_secret"))
        got = row.select(F.hex(F.aes_encrypt("t", privacy._key(algorithm), F.lit("ECB")))).first()[0]
        assert got[:32].lower() == locked


def test_mask_leaves_no_match(spark):
    text = spark.createDataFrame([("mail bob@example.com or 10.0.0.1",)], "t string")
    assert text.select(privacy.pii_mask(F.col("t"))).first()[0] == "mail <EMAIL> or <IPV4>"


def test_copula_keeps_shape(spark):
    rng = random.Random(1)
    data = []
    for _ in range(3000):
        a = rng.gauss(0, 1)
        data.append((a, 2 * a + rng.gauss(0, 0.5), "x" if rng.random() < 0.7 else "y", None if rng.random() < 0.2 else rng.randint(1, 9)))
    real = spark.createDataFrame(data, "a double, b double, c string, d int")
    model = copula.fit(real)
    made = model.sample(spark, 4000, partitions=3)
    assert made.dtypes == real.dtypes
    assert rows(made.orderBy("a").limit(20)) == rows(model.sample(spark, 4000, partitions=9).orderBy("a").limit(20))
    assert all(r["score"] < 0.06 for r in fidelity.audit_quality(real, made).collect())
    assert fidelity.correlation_preservation(real, made).first()["max_correlation_difference"] < 0.08
    assert abs(made.filter("d is null").count() / 4000 - 0.2) < 0.05


def test_plugins():
    assert isinstance(copula.plugin("COPULA"), copula.CopulaPlugin)
    with pytest.raises(ValueError):
        copula.plugin("gan")
    with pytest.raises(ValueError):
        copula.CopulaPlugin().generate(None, 1)


def test_children_of_a_hot_parent(spark):
    counts = spark.createDataFrame([(1, 25_001), (2, 0), (3, 1)], "id bigint, children bigint")
    got = copula.spread_children(counts)
    assert got.count() == 25_002 and got.distinct().count() == 25_002


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "sub" / "b.csv").write_text("yy")
    assert io.file_inventory(spark, str(tmp_path), "*.csv").count() == 1
    deep = io.file_inventory(spark, str(tmp_path), "*.csv", recursive=True).collect()
    assert {(r["name"], r["size"], r["extension"]) for r in deep} == {("a.csv", 1, ".csv"), ("b.csv", 2, ".csv")}
    got = dict((r["directory"], (r["size"], r["files"])) for r in io.storage_stats(spark, {"seed_data": str(tmp_path)}).collect())
    assert got == {"seed_data": (3, 2), "*": (3, 2)}
    assert rows(io.scan_csv_folder(spark, str(tmp_path)).select("table_name")) == [("a",)]
    with pytest.raises(ValueError):
        io.write_table(spark.range(1), str(tmp_path / "x"), "xml")


def test_first_terminal_status_ends_a_job(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00", 7, "running"), (2, "2024-01-01 00:01:00", 7, "completed"), (3, "2024-01-01 00:02:00", 7, "running"), (4, "2024-01-01 00:00:30", 8, "pending")]
    df = spark.createDataFrame(data, "event_id bigint, ts string, job_id bigint, status string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for i in range(4):  # one file, so one possible batch, per event
        df.filter(F.col("event_id") == i + 1).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    stream = streams.event_stream(spark, f"{tmp_path}/part*", df.schema, "*.parquet")
    assert sorted(rows(streams.latest_status(stream, f"{tmp_path}/status"))) == [(7, "completed", True), (8, "pending", False)]
    assert streams.ingest_once(stream.unionByName(stream), f"{tmp_path}/ingest").count() == 4


def test_streams_resume_in_their_folder(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, job_id bigint, status string"
    event = lambda i, status: spark.sql(f"SELECT {i}L AS event_id, timestamp_ntz'2024-01-01 00:0{i}:00' AS ts, 7L AS job_id, '{status}' AS status").coalesce(1)
    stream = lambda: streams.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
    event(1, "running").write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(streams.latest_status(stream(), f"{tmp_path}/s")) == [(7, "running", False)]
    assert streams.ingest_once(stream(), f"{tmp_path}/i").count() == 1
    event(1, "running").write.mode("append").parquet(f"{tmp_path}/in")  # delivered again
    event(2, "completed").write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(streams.latest_status(stream(), f"{tmp_path}/s")) == [(7, "completed", True)]
    assert sorted(r["event_id"] for r in streams.ingest_once(stream(), f"{tmp_path}/i").collect()) == [1, 2]
    assert sorted(r["event_id"] for r in streams.ingest_once(stream(), f"{tmp_path}/i").collect()) == [1, 2]


def test_late_events_are_kept_once_and_set_aside(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, job_id bigint, status string"
    add = lambda *rows: spark.createDataFrame(rows, "event_id bigint, ts string, job_id bigint, status string").selectExpr(
        "event_id", "CAST(ts AS timestamp_ntz) ts", "job_id", "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: streams.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    assert streams.late_events(spark, f"{tmp_path}/i") is None
    add((1, "2024-01-01 12:00:00", 7, "running"), (2, "2024-01-01 08:00:00", 8, "completed"))
    assert ids(streams.ingest_once(stream(), f"{tmp_path}/i")) == [1, 2] and ids(streams.late_events(spark, f"{tmp_path}/i")) == []
    add((3, "2024-01-01 09:00:00", 8, "running"), (3, "2024-01-01 09:00:00", 8, "running"), (2, "2024-01-01 08:00:00", 8, "completed"), (4, "2024-01-01 11:30:00", 9, "pending"))
    assert ids(streams.ingest_once(stream(), f"{tmp_path}/i")) == [1, 2, 3, 4] and ids(streams.late_events(spark, f"{tmp_path}/i")) == [3]
    add((3, "2024-01-01 09:00:00", 8, "running"), (5, "2024-01-01 07:00:00", 9, "running"))
    assert ids(streams.ingest_once(stream(), f"{tmp_path}/i")) == [1, 2, 3, 4, 5] and ids(streams.late_events(spark, f"{tmp_path}/i")) == [3, 5]
    assert sorted(rows(streams.latest_status(stream(), f"{tmp_path}/s"))) == [(7, "running", False), (8, "completed", True), (9, "pending", False)]
    assert not (tmp_path / "s" / "state" / "state").exists()  # no job is held in state


def test_csv_folders_are_discovered(spark, tmp_path):
    real, synth = tmp_path / "real", tmp_path / "made"
    users = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    io.write_set({"users": users, "only_real": users}, str(real))
    io.write_table(users, f"{synth}/users_synthetic.csv")
    (real / "plain.csv").write_text("a,b\n1,2\n")
    left, right = io.load_datasets(spark, str(real), str(synth), {"users": users.schema})
    assert sorted(left) == ["only_real", "plain", "users"] and list(right) == ["users"]
    assert io.common_tables(left, right) == ["users"] and left["plain"].columns == ["a", "b"]
    assert rows(fidelity.evaluate_named("users", left, right).filter("metric = 'generation_ratio'").select("value")) == [(1.0,)]
    with pytest.raises(ValueError):
        fidelity.evaluate_named("plain", left, right)
    report = fidelity.quality_report(left, right)
    assert fidelity.quality_overall(report).first()["tables"] == 1


def test_unknown_template(spark):
    from mockloom.plans import flows

    with pytest.raises(ValueError):
        flows.from_template(spark, "huge", {}, {})
    made, report = flows.from_template(
        spark, "balanced", {"databases": [{"tables": [{"name": "t", "attributes": [{"name": "id", "type": "INT"}, {"name": "e", "type": "ENUM"}]}]}]}, {"t": 200}
    )
    assert made["t"].count() == 1000 and report.filter("metric = 'generation_ratio'").first()["value"] == 5.0


# --- plans --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["audit_quality", "leakage_rate", "k_anonymity", "gen_table", "ddl_attributes", "doc_infer_schema", "schema_flatten", "generation_levels"])
def test_native_plans(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_audit_shuffles_values_once(spark):
    from mockloom.plans.derive import orders_pair

    real, synth = orders_pair(spark, SF_DIR)
    df = fidelity.ks_statistic(real, synth, ["o_custkey", "o_totalprice"])
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_two_columns(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    pair = [lines.filter(F.col("l_linestatus") == s) for s in "OF"]
    plan = fidelity.ks_statistic(*pair, ["l_quantity"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_linestatus:string>" in plan and "EqualTo(l_linestatus,O)" in plan


# --- constants, depth, keys ------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [2, 3, 7, 16])
def test_constants_in_many_partitions(spark, partitions):
    df = spark.range(49 * partitions).select(F.lit(0.1).alias("fixed"), F.col("id").cast("double").alias("x")).repartition(partitions)
    cells = {(r["col_a"], r["col_b"]): r["corr"] for r in fidelity.correlation_matrix(df, ["fixed", "x"]).collect()}
    assert cells["fixed", "fixed"] is None and cells["fixed", "x"] is None and cells["x", "x"] == 1.0
    stats = {r["column_name"]: r for r in fidelity.basic_statistics(df, df).collect()}
    assert stats["fixed"]["real_std"] == 0.0 and stats["fixed"]["relative_std_difference"] == 0.0


def test_ddl_brackets_nest_to_any_depth(spark):
    deep = "(" * 12 + "a > 0" + ")" * 12
    text = f"CREATE TABLE t (a INT DEFAULT {deep}, b VARCHAR(10) NOT NULL, CHECK {deep});\nCREATE TABLE u (c INT;"
    got = {r["column_name"]: r for r in ddl.attributes(spark.createDataFrame([("f", text)], "path string, value string")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["default_value"] == deep and got["b"]["type_params"] == "10"


def test_ddl_knows_all_delimiters(spark):
    text = 'CREATE TABLE "my db"."the table" ("id" INT PRIMARY KEY, [other id] INT REFERENCES [parent] ("id"), `n` INT, FOREIGN KEY fk1 ("n") REFERENCES x."p" ([k]));'
    got = {r["column_name"]: r for r in ddl.attributes(spark.createDataFrame([("f", text)], "path string, value string")).collect()}
    assert {(r["database"], r["table_name"]) for r in got.values()} == {("my db", "the table")}
    assert set(got) == {"id", "other id", "n"} and got["other id"]["constraints"] == [FK + "parent.id"]
    assert got["id"]["constraints"] == ["PRIMARY_KEY"] and got["n"]["constraints"] == [FK + "p.k"]


def test_strict_order_refuses_cycles():
    tag = lambda t: {"name": "k", "type": "INT", "constraints": [f"{FK}{t}.id"]}
    schema = {"databases": [{"tables": [{"name": "a", "attributes": [tag("b")]}, {"name": "b", "attributes": [tag("a")]}, {"name": "c"}]}]}
    assert generate.generation_order(schema) == ["a", "c", "b"]
    with pytest.raises(ValueError):
        generate.generation_order(schema, strict=True)


def test_foreign_key_without_parents(spark):
    child, parent = spark.range(500), spark.createDataFrame([], "k long")
    made = generate.fk_from_table(child, "id", parent, "k", "parent_id")
    low, high = made.agg(F.min("parent_id"), F.max("parent_id")).first()
    assert made.count() == 500 and low >= 1 and high <= 100 and dict(made.dtypes)["parent_id"] == "bigint"


def test_copula_of_times_and_many_values(spark):
    real = spark.range(4000).select(
        F.timestamp_micros(F.col("id") * 3_600_000_000).alias("at"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("local"),
        F.date_from_unix_date((F.col("id") % 700).cast("int")).alias("day"), (F.col("id") % 3 == 0).alias("flag"),
        F.concat(F.lit("value "), (F.col("id") % 1500).cast("string")).alias("text"), F.lit(None).cast("string").alias("none"),
    )
    made = copula.fit(real).sample(spark, 3000)
    assert made.dtypes == real.dtypes and made.count() == 3000
    assert made.join(real, "text", "left_anti").count() == 0 and made.select("text").distinct().count() > 1000
    assert abs(made.filter("flag").count() / 3000 - 1 / 3) < 0.04
    first, last = made.agg(F.min("at"), F.max("at")).first()
    edge = real.agg(F.min("at"), F.max("at")).first()
    assert edge[0] <= first and last <= edge[1] and made.filter("none is not null").count() == 0


def test_plugins_are_listed():
    assert copula.plugins() == ["copula"]


def test_ddl_files_are_dealt_out_before_they_are_read(spark):
    corpus = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("USE d;\nCREATE TABLE t"), "id", F.lit(" (a INT);\n")).alias("value"))
    found = ddl.statements(corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # upper steps come first: the texts are cut in many tasks
    assert found.filter("used = 'd'").count() == 400


@pytest.mark.parametrize("strict", [False, True])
def test_ddl_brackets_beyond_one_pattern(spark, strict):
    deep = "(" * 9 + "1, 2" + ")" * 9
    texts = [f"CREATE TABLE t (a INT,\n b DECIMAL{deep} DEFAULT {deep},\n c ENUM('(',')') , , d INT)", "CREATE TABLE t (a INT, b INT", "CREATE TABLE t (a INT, b CHAR(3) DEFAULT ')', c INT) x (d INT)"]
    got = ddl.attributes(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, value string"), strict)
    names = {r["path"]: r["n"] for r in got.groupBy("path").agg(F.sort_array(F.collect_list("column_name")).alias("n")).collect()}
    assert names == {"0": ["a", "b", "c", "d"], "2": ["a", "b", "c"]}
    if not strict:
        b = got.filter("path = '0' and column_name = 'b'").first()
        assert b["default_value"] == deep and b["type_params"] == deep[1:-1].replace(", ", ",")


def test_middles_of_columns(spark):
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), rng.choice([1, 1, 1, 2]), None if rng.random() < 0.3 else rng.randint(0, 10**6), None) for _ in range(5001)]
    df = spark.createDataFrame(data, "a double, b int, c bigint, d double")
    wanted = df.agg(*[F.percentile(c, 0.5).alias(c) for c in "abc"]).first().asDict()
    for room in (0.002, 1e-7):  # the second leaves the middle out, so that whole columns are counted
        assert {r["column_name"]: r["median"] for r in fidelity.medians(df, ["a", "b", "c", "d"], room).collect()} == wanted
    plan = fidelity.medians(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan  # never all values of a column in one task


def test_correlations_add_up_over_tasks(spark):
    rng = random.Random(5)
    data = [(1e9 + i, 1e9 + i + rng.gauss(0, 50), None if i % 3 else float(i * i), 7.0, None if i % 3 == 0 else 1.0 * i) for i in range(900)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double").repartition(5)
    pairs = {(r["col_a"], r["col_b"]): r["corr"] for r in fidelity.correlation_matrix(df, list("abcde")).collect()}
    import numpy as np

    x = np.array([[np.nan if v is None else v for v in r] for r in data])
    for i, j in ((0, 1), (0, 2), (1, 2), (0, 4)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(pairs["abcde"[i], "abcde"[j]] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
        assert pairs["abcde"[i], "abcde"[j]] == pairs["abcde"[j], "abcde"[i]]
    assert len(pairs) == 25 and pairs["a", "a"] == 1.0 and pairs["d", "d"] is None and pairs["a", "d"] is None and pairs["c", "e"] is None
    empty = fidelity.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_few_texts_never_deal_out_the_rows(spark):
    real = spark.range(3000).select((F.col("id") % 2).cast("string").alias("side"), (F.col("id") % 97).cast("double").alias("x"))
    model = copula.fit(real)
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = copula.as_shares(model, real)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_drawing_is_one_function_of_batches(spark):
    model = copula.fit(spark.range(500).select(F.col("id").cast("double").alias("x"), (F.col("id") % 5).alias("k"), (F.col("id") % 3).cast("string").alias("t")))
    plan = model.sample(spark, 100)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "cos(" not in plan.lower()  # as a Spark expression too long a method for Java to compile
    from mockloom.functions import normal as gauss
    from mockloom.functions import rng as draws

    ids = spark.range(50).withColumnRenamed("id", "row")
    rows_ = ids.select(*[n.alias(f"n{i}") for i, n in enumerate(draws.normals(1, "t", F.col("row"), 3))], gauss.cdf(draws.normals(1, "t", F.col("row"), 1)[0]).alias("p"),
                       *[b.alias(f"b{i}") for i, b in enumerate(draws.normal_bits(1, "t", F.col("row"), 3))]).toPandas()
    made = draws.normals_of(3)([rows_["b0"].to_numpy(), rows_["b1"].to_numpy()])
    assert all(abs(made[i] - rows_[f"n{i}"]).max() < 1e-12 for i in range(3)) and abs(gauss.cdf_of()(made[0]) - rows_["p"]).max() < 1e-12
