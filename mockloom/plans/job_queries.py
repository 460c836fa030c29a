"""Job, dashboard and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mockloom.operators import jobs as ops
from mockloom.plans.catalog_queries import SCHEMAS, schemas
from mockloom.plans.derive import table
from mockloom.plans.generation_queries import STAR
from mockloom.plans.registry import query
from mockloom.session import scratch_path
from mockloom.streaming import jobs as streams
from mockloom.streaming import queue

# --- jobs from orders, updates and logs from events -----------------------------------------

JOBS = """jobs AS (SELECT o_orderkey AS job_id, 'schema_' || o_custkey AS schema_id,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderstatus = 'P' THEN 'priority ' || o_orderpriority END AS error_message FROM orders)"""
EVENT_STATUS = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"""


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("schema_"), F.col("o_custkey").cast("string")).alias("schema_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("priority "), "o_orderpriority")).alias("error_message"),
    )


def _status(kind):
    return F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running")


@query(
    "job_stats",
    f"""WITH {JOBS} SELECT count(*) AS total, 0 AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed, 0 AS cancelled, count(*) FILTER (status = 'running') AS active,
 round(count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')) * 100, 2) AS success_rate FROM jobs""",
)
def job_stats(spark, sf_dir):
    return ops.stats(jobs(spark, sf_dir))


@query(
    "job_list",
    f"""WITH {JOBS} SELECT job_id, schema_id, status, created_at, coalesce(error_message, '') AS message FROM jobs
 ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 10""",
)
def job_list(spark, sf_dir):
    return ops.newest(jobs(spark, sf_dir), 50, 10)


@query(
    "job_fold",
    f"""SELECT user_id AS job_id, arg_max({EVENT_STATUS}, (ts, event_id)) AS status,
 arg_max(value, (ts, event_id)) FILTER (event_type IN ('click', 'view')) AS progress, arg_max('E' || event_id, (ts, event_id)) FILTER (event_type = 'error') AS error_message
 FROM events GROUP BY user_id""",
)
def job_fold(spark, sf_dir):
    kind = F.col("event_type")
    updates = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", _status(kind).alias("status"),
        F.when(kind.isin("click", "view"), F.col("value")).alias("progress"),
        F.when(kind == "error", F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error_message"),
    )
    return ops.fold_updates(updates, "job_id", ["ts", "event_id"], ["status", "progress", "error_message"])


@query(
    "job_audit",
    """WITH l AS (SELECT event_id AS log_id, user_id AS job_id, event_type AS step_name, ts AS logged_at,
   lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_at FROM events)
SELECT log_id, job_id, step_name, logged_at, previous_at, round(date_diff('microsecond', previous_at, logged_at) / 1e6, 6) AS seconds_since_previous
FROM l WHERE job_id IN (SELECT o_orderkey FROM orders)""",
)
def job_audit(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("step_name"), F.col("ts").alias("logged_at")
    )
    steps = ops.audit_steps(jobs(spark, sf_dir), logs)
    return steps.withColumn("seconds_since_previous", F.round("seconds_since_previous", 6))


# --- dashboard ----------------------------------------------------------------------------------


@query(
    "dash_overview",
    f"""WITH {SCHEMAS}, {JOBS}, rate AS (SELECT round(count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')) * 100, 2) AS r FROM jobs)
SELECT 'schemas' AS section, 'total' AS metric, (SELECT count(*) FROM schemas)::DOUBLE AS value UNION ALL SELECT 'schemas', 'total_tables', (SELECT count(*) FROM tabs)
UNION ALL SELECT 'sources', coalesce(source, 'sql_upload'), count(*) FROM schemas GROUP BY ALL
UNION ALL SELECT 'jobs', 'total', count(*) FROM jobs UNION ALL SELECT 'jobs', s, (SELECT count(*) FROM jobs WHERE status = s)
   FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) AS v(s)
UNION ALL SELECT 'jobs', 'success_rate', r FROM rate UNION ALL SELECT 'jobs', 'active', (SELECT count(*) FROM jobs WHERE status = 'running')
UNION ALL SELECT 'synthetic_files', 'total', count(*) FROM pages UNION ALL SELECT 'synthetic_files', 'total_size', sum(length(html)) FROM pages""",
)
def dash_overview(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.length("html").alias("size"))
    return ops.overview(schemas(spark, sf_dir), jobs(spark, sf_dir), files)


@query(
    "dash_activity",
    f"""WITH {SCHEMAS}, {JOBS}, u AS (SELECT 'schema_parsed' AS type, schema_id AS id, coalesce(source, 'sql_upload') AS source, filename, NULL AS message,
   TIMESTAMP '2000-01-01' + to_seconds((created_at - 1.7e9)::BIGINT * 60 * 24 * 3600) AS "at" FROM schemas
 UNION ALL (SELECT 'job_' || status, job_id::VARCHAR, 'synthetic_generation', NULL, coalesce(error_message, ''), created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 100))
SELECT * FROM u ORDER BY "at" DESC, type, id DESC LIMIT 120""",
)
def dash_activity(spark, sf_dir):
    offset = F.make_dt_interval((F.col("created_at") - 1.7e9).cast("int") * 60)
    dated = schemas(spark, sf_dir).withColumn("created_at", F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'") + offset)
    return ops.activity(dated, jobs(spark, sf_dir), 120)


@query(
    "dash_schema_stats",
    f"""WITH {SCHEMAS}, tag_n AS (SELECT schema_id, tag, count(*) AS n FROM (SELECT schema_id, unnest(tags) AS tag FROM attrs) GROUP BY ALL)
SELECT schema_id, filename, coalesce(source, 'sql_upload') AS source, (SELECT count(*) FROM dbs WHERE dbs.schema_id = s.schema_id) AS database_count,
 (SELECT count(*) FROM tabs WHERE tabs.schema_id = s.schema_id) AS table_count, (SELECT count(*) FROM attrs WHERE attrs.schema_id = s.schema_id) AS column_count,
 coalesce((SELECT string_agg(tag || ':' || n, '|' ORDER BY tag) FROM tag_n WHERE tag_n.schema_id = s.schema_id), '') AS constraints, file_size, created_at FROM schemas s""",
)
def dash_schema_stats(spark, sf_dir):
    line = lambda x: F.concat_ws(":", x.tag, x.n.cast("string"))
    return ops.schema_analytics(schemas(spark, sf_dir)).withColumn("constraints", F.array_join(F.transform("constraints", line), "|"))


@query(
    "dash_table_spread",
    f"""WITH {SCHEMAS}, c AS (SELECT s.schema_id, count(t.schema_id) AS n FROM schemas s LEFT JOIN tabs t USING (schema_id) GROUP BY 1)
SELECT count(*) AS total_schemas, round(avg(n), 6) AS avg_tables, max(n) AS max_tables, min(n) AS min_tables FROM c""",
)
def dash_table_spread(spark, sf_dir):
    return ops.table_spread(schemas(spark, sf_dir)).withColumn("avg_tables", F.round("avg_tables", 6))


_PLAN = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS planned_rows FROM {t}" for t in STAR)


@query(
    "gen_events",
    f"""WITH plan AS ({_PLAN}), i AS (SELECT *, row_number() OVER (ORDER BY table_name) AS idx FROM plan)
SELECT 'start' AS event, 0 AS "index", NULL AS table_name, (SELECT count(*) FROM plan) AS rows, 0 AS step
UNION ALL SELECT 'table_start', idx, table_name, NULL, 1 FROM i
UNION ALL SELECT CASE WHEN planned_rows <= 20000 THEN 'table_done' ELSE 'error' END, idx, table_name, CASE WHEN planned_rows <= 20000 THEN planned_rows END, 2 FROM i
UNION ALL SELECT 'complete', (SELECT count(*) + 1 FROM plan), NULL, (SELECT count(*) FROM plan), 0""",
)
def gen_events(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("planned_rows")).select(F.lit(t).alias("table_name"), "planned_rows") for t in STAR]
    plan = parts[0]
    for p in parts[1:]:
        plan = plan.unionByName(p)
    return ops.progress_events(plan, 20_000)


# --- streams ----------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = streams.event_stream(spark, sf_dir, schema, "events.parquet")
    return stream.select("event_id", "ts", F.col("user_id").alias("job_id"), _status(F.col("event_type")).alias("status"))


@query(
    "stream_latest_status",
    f"""WITH e AS (SELECT user_id AS job_id, ts, event_id, {EVENT_STATUS} AS status FROM events)
SELECT job_id, coalesce(arg_min(status, (ts, event_id)) FILTER (status IN ('completed', 'failed')), arg_max(status, (ts, event_id))) AS status,
 count(*) FILTER (status IN ('completed', 'failed')) > 0 AS finished FROM e GROUP BY job_id""",
)
def stream_latest_status(spark, sf_dir):
    return streams.latest_status(_events(spark, sf_dir), scratch_path(spark, "latest-status"))


@query("stream_ingest_dedup", f"SELECT event_id, user_id AS job_id, {EVENT_STATUS} AS status FROM events")
def stream_ingest_dedup(spark, sf_dir):
    twice = _events(spark, sf_dir).unionByName(_events(spark, sf_dir))  # every event delivered twice
    return streams.ingest_once(twice, scratch_path(spark, "ingest")).select("event_id", "job_id", "status")


@query(
    "stream_job_stats",
    f"""WITH e AS (SELECT {EVENT_STATUS} AS status FROM events) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('running', 'pending')) AS active,
 round(count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')) * 100, 2) AS success_rate FROM e""",
)
def stream_job_stats(spark, sf_dir):
    return streams.running_stats(_events(spark, sf_dir), scratch_path(spark, "job-stats"))


def _bill(job: dict) -> dict:
    """Handler of the queue's jobs: refuses accounts in debt."""
    if job["balance"] < 0:
        raise ValueError("in debt")
    return {"cents": round(job["balance"] * 100)}


@query(
    "stream_job_queue",
    """SELECT 'supplier_' || s_suppkey AS message, CASE WHEN s_acctbal < 0 THEN 2 ELSE 1 END::INT AS attempt, CASE WHEN s_acctbal < 0 THEN 'dead' ELSE 'done' END AS status,
 CASE WHEN s_acctbal >= 0 THEN '{"cents": ' || round(s_acctbal * 100)::BIGINT || '}' END AS result, CASE WHEN s_acctbal < 0 THEN 'ValueError: in debt' END AS error FROM supplier""",
)
def stream_job_queue(spark, sf_dir):
    """A job for each supplier; two rounds, so that those in debt fail twice and are set aside."""
    jobs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("job_id"), F.col("s_acctbal").alias("balance")
    )
    root = scratch_path(spark, "queue")
    queue.enqueue(jobs, f"{root}/queue")
    queue.work_off(spark, f"{root}/queue", f"{root}/work", _bill, attempts=2)
    return queue.work_off(spark, f"{root}/queue", f"{root}/work", _bill, attempts=2)
