"""Events delivered at least once, each kept once, at a cost per batch that history does not raise.

Three folders below the caller's own:

* ``events/_batch=N/_late=../_bucket=..`` holds the events a batch has added, in one write;
* ``recent/_batch=N`` the keys and times of all events at or after the watermark of the next batch;
* ``whole/_upto=N`` the events of all batches up to N, once ``compact`` has merged them.

A folder counts once its ``_SUCCESS`` file is there; a replayed batch overwrites what an earlier try left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.streaming.batches import run_batches

#: Parts that the keys of a batch are filed in, so that late events read only their own parts of history.
BUCKETS = 64


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, folder: str, label: str) -> list[int]:
    """Numbers of the finished ``<label>=<number>`` folders, ascending."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{label}="))
    return [n for n in numbers if files.exists(_path(spark, f"{folder}/{label}={n}/_SUCCESS")[0])]


def _stored(batch_schema: T.StructType) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType) for f in batch_schema]
    return T.StructType([*fields, T.StructField("_late", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])


def _history(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Events of all finished batches below ``before``."""
    merged = [n for n in complete(spark, f"{root}/whole", "_upto") if before is None or n < before][-1:]
    batches = [n for n in complete(spark, f"{root}/events", "_batch") if (before is None or n < before) and n > max(merged, default=-1)]
    stored = _stored(schema)
    out = spark.createDataFrame([], stored)
    for kind, label, numbers in (("whole", "_upto", merged), ("events", "_batch", batches)):
        if numbers:
            paths = [f"{root}/{kind}/{label}={n}" for n in numbers]
            out = out.unionByName(spark.read.schema(stored).option("basePath", f"{root}/{kind}").parquet(*paths).select(stored.names))
    return out


def _added(spark: SparkSession, root: str) -> DataFrame | None:
    found = complete(spark, f"{root}/events", "_batch")
    if not found:
        return None
    files = spark.read.parquet(f"{root}/recent/_batch={found[-1]}")
    schema = T.StructType.fromJson(files.schema["_key"].metadata["events"])
    return _history(spark, root, schema)


def late_events(spark: SparkSession, root: str) -> DataFrame | None:
    """Events that ``ingest_once`` kept although they came behind the watermark or without a time; None before its first batch."""
    added = _added(spark, root)
    return None if added is None else added.filter("_late").drop("_late", "_bucket")


def ingest_once(events: DataFrame, root: str, key: str = "event_id", delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """All events so far, each once, however late; a redelivery carries the time (``ts``) of the event itself.

    An event is late if it is more than ``delay`` older than the newest one of
    earlier batches, or has no time; the side table ``late_events`` shows those. An event in time is held
    against the keys since the watermark only; a late one against the keys of all
    batches, of which only the buckets of late events are read. Of several events with
    one key in a batch the smallest stays, by time and then by the other columns, which
    must be sortable. A key that comes again with another time is recognised if the
    earlier event lies after the watermark or the later one before it. A folder keeps the number of ``buckets`` it began with.
    """
    schema = events.schema
    rest = ["ts", *[c for c in events.columns if c not in (key, "ts")]]
    same = lambda x, y: F.col(f"{x}.{key}").eqNullSafe(F.col(f"{y}.{key}"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").withColumn("_bucket", bucket)
        recent, watermark = None, F.lit(None).cast("timestamp")
        if batch_id:
            recent = spark.read.parquet(f"{root}/recent/_batch={batch_id - 1}")
            begun = recent.schema["_key"].metadata["buckets"]
            if begun != buckets:
                raise ValueError(f"{root} was begun with {begun} buckets, not {buckets}")
            newest = recent.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
            watermark = F.timestamp_micros(F.lit(newest).cast("long"))
        behind = F.coalesce(F.col("ts") < watermark, F.col("ts").isNull())
        rows = rows.withColumn("_late", behind)
        fresh = rows
        if recent is not None:
            in_time = rows.filter("NOT _late").alias("new").join(recent.withColumnRenamed("_key", key).alias("old"), same("new", "old"), "left_anti")
            late = rows.filter("_late")
            touched = [r[0] for r in late.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            if touched:
                filed = _history(spark, root, schema, batch_id).filter(F.col("_bucket").isin(touched)).select(key)
                seen = filed.alias("old").join(late.select(key).alias("new"), same("old", "new"), "left_semi")
                late = late.alias("new").join(seen.alias("old"), same("new", "old"), "left_anti")
            fresh = in_time.unionByName(late)
        folder = f"{root}/events/_batch={batch_id}"
        fresh.select(*schema.names, "_late", "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_late", "_bucket").parquet(folder)

        # from what was written, so that both folders agree even if a lost block is made anew
        added = spark.read.schema(_stored(schema)).parquet(folder).filter("NOT _late")
        known = added.select(F.col(key).alias("_key"), "ts")
        if recent is not None:
            known = known.unionByName(recent)
        last = known.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
        known = known.filter(F.col("ts") >= F.timestamp_micros(F.lit(last).cast("long")))
        about = {"buckets": buckets, "events": schema.jsonValue()}
        known.select(F.col("_key").alias("_key", metadata=about), "ts").write.mode("overwrite").parquet(f"{root}/recent/_batch={batch_id}")

    run_batches(events, "append", root, write)
    return _history(events.sparkSession, root, schema).drop("_late", "_bucket")


def compact(spark: SparkSession, root: str) -> int | None:
    """Merge the batches of ``ingest_once`` but the newest, which may still be replayed; not while a batch runs.

    Returns the number of the last merged batch, None if there was nothing to merge.
    The merged folder counts before the single ones are deleted, so a crash in between loses and doubles nothing.
    """
    batches = complete(spark, f"{root}/recent", "_batch")
    merged = complete(spark, f"{root}/whole", "_upto")
    if len(batches) > 1 and batches[-2] > max(merged, default=-1):
        newest = batches[-1]
        about = spark.read.parquet(f"{root}/recent/_batch={newest}").schema["_key"].metadata["events"]
        everything = _history(spark, root, T.StructType.fromJson(about), newest)
        everything.repartition("_bucket").write.mode("overwrite").partitionBy("_late", "_bucket").parquet(f"{root}/whole/_upto={batches[-2]}")
        merged.append(batches[-2])
    if not merged:
        return None
    gone = [f"{root}/whole/_upto={n}" for n in merged[:-1]]
    gone += [f"{root}/{kind}/_batch={n}" for kind in ("events", "recent") for n in complete(spark, f"{root}/{kind}", "_batch") if n <= merged[-1] and n + 1 < batches[-1]]
    for name in gone:
        path, files = _path(spark, name)
        files.delete(path, True)
    return merged[-1]
