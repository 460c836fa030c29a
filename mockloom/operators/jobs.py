"""Reports over jobs, audit logs, schemas and generation plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mockloom.operators.catalog import all_attributes, with_counts
from mockloom.operators.scan import lookup_by_key, with_neighbours

STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
TERMINAL = ["completed", "failed", "cancelled"]
DEFAULT_SOURCE = "sql_upload"


def success_rate(completed: Column, failed: Column) -> Column:
    """Percentage of finished jobs that completed, 100 when none finished."""
    return F.round(F.coalesce(F.try_divide(completed, completed + failed) * 100, F.lit(100.0)), 2)


def stats(jobs: DataFrame) -> DataFrame:
    """Totals by status in one pass."""
    counted = jobs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )
    return counted.withColumn("success_rate", success_rate(F.col("completed"), F.col("failed"))).withColumn(
        "active", F.col("running") + F.col("pending")
    )


def newest(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of jobs, newest first, with an empty message where there is none."""
    page = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(offset).limit(limit)
    return page.withColumn("message", F.coalesce("error_message", F.lit(""))).drop("error_message")


def fold_updates(updates: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Current state per job: the latest non-null value of every column, combined map-side."""
    at = F.struct(*order)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return updates.groupBy(key).agg(*[latest(c) for c in columns])


def audit_steps(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Audit rows of known jobs with the seconds since the job's previous step."""
    known = lookup_by_key(logs, jobs.select("job_id").distinct(), ["job_id"])
    timed = with_neighbours(known, ["job_id"], ["logged_at", "log_id"], "logged_at", before="previous_at")
    seconds = F.timestamp_diff("MICROSECOND", F.col("previous_at"), F.col("logged_at")) / 1e6
    return timed.withColumn("seconds_since_previous", seconds)


# --- dashboard --------------------------------------------------------------------------


def overview(schemas: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(section, metric, value) rows: schemas and their sources, jobs, stored files."""
    row = lambda df, section, metric, value: df.select(
        F.lit(section).alias("section"), metric.alias("metric"), value.cast("double").alias("value")
    )

    def melt(df: DataFrame, section: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.lit(section).alias("section"), F.inline(cells))

    counted = with_counts(schemas)
    parts = [
        melt(counted.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("table_count"), F.lit(0)).alias("total_tables")), "schemas"),
        row(
            counted.groupBy(F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("s")).agg(F.count(F.lit(1)).alias("n")),
            "sources", F.col("s"), F.col("n"),
        ),
        melt(stats(jobs), "jobs"),
        melt(files.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")), "synthetic_files"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def activity(schemas: DataFrame, jobs: DataFrame, limit: int = 20, recent_jobs: int = 100) -> DataFrame:
    """Newest schema and job events together; each side is cut to its own newest first."""
    uploads = schemas.select(
        F.lit("schema_parsed").alias("type"), F.col("schema_id").alias("id"),
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"), "filename", F.col("created_at").alias("at"),
    )
    runs = newest(jobs, recent_jobs).select(
        F.concat(F.lit("job_"), "status").alias("type"), F.col("job_id").cast("string").alias("id"),
        F.lit("synthetic_generation").alias("source"), "message", F.col("created_at").alias("at"),
    )
    return uploads.unionByName(runs, allowMissingColumns=True).orderBy(F.col("at").desc_nulls_last(), "type", F.col("id").desc()).limit(limit)


def schema_analytics(schemas: DataFrame) -> DataFrame:
    """Counts and constraint histogram of each schema, worked out inside its row."""
    tags = F.flatten(F.transform(all_attributes(F.col("databases")), lambda a: F.coalesce(a.constraints, F.array().cast("array<string>"))))
    histogram = F.transform(
        F.array_sort(F.array_distinct(F.col("_tags"))),
        lambda t: F.named_struct(F.lit("tag"), t, F.lit("n"), F.size(F.filter("_tags", lambda x: x == t))),
    )
    return (
        with_counts(schemas)
        .withColumn("_tags", F.coalesce(tags, F.array().cast("array<string>")))
        .select(
            "schema_id", "filename", F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
            "database_count", "table_count", "column_count", histogram.alias("constraints"), "file_size", "created_at",
        )
    )


def table_spread(schemas: DataFrame) -> DataFrame:
    """Average, largest and smallest table count, zero without schemas."""
    counted = with_counts(schemas)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counted.agg(
        F.count(F.lit(1)).alias("total_schemas"),
        zero(F.avg("table_count")).alias("avg_tables"),
        zero(F.max("table_count")).alias("max_tables"),
        zero(F.min("table_count")).alias("min_tables"),
    )


def progress_events(plan: DataFrame, max_rows: int) -> DataFrame:
    """Events of a generation run, from its plan (table_name, planned_rows): one row per table."""
    # a plan has one row per table of one request, so this window is small
    indexed = plan.withColumn("index", F.row_number().over(Window.orderBy("table_name")))
    done = F.when(
        F.col("planned_rows") <= max_rows,
        F.struct(F.lit("table_done").alias("event"), F.col("planned_rows").alias("rows"), F.lit(2).alias("step")),
    ).otherwise(F.struct(F.lit("error").alias("event"), F.lit(None).cast("bigint").alias("rows"), F.lit(2).alias("step")))
    begun = F.struct(F.lit("table_start").alias("event"), F.lit(None).cast("bigint").alias("rows"), F.lit(1).alias("step"))
    per_table = indexed.select("index", "table_name", F.inline(F.array(begun, done)))
    edge = lambda event, index: plan.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(event).alias("event"), "rows", index.cast("int").alias("index"), F.lit(0).alias("step")
    )
    last = plan.agg(F.count(F.lit(1))).scalar() + 1
    return (
        per_table.unionByName(edge("start", F.lit(0)), allowMissingColumns=True)
        .unionByName(edge("complete", last), allowMissingColumns=True)
    )
