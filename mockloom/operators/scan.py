"""Running sums and key lookups that keep hot groups out of single tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mockloom.session import parallelism, scratch_path, shared_dir


#: Setting by which Spark drops the shuffles of a query when it has ended.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, drop: bool = False) -> DataFrame:
    """Written to the shared folder once, for results that several later steps read.

    Files are read back without the constraints of the plan that made them. A checkpoint
    keeps those, and in rounds that each settle the last one's rows they multiply, so that the
    driver plans for minutes what takes seconds to run. With ``drop`` the shuffles of the writing
    are deleted as soon as it has ended; otherwise they stay until Java collects their plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    before = spark.conf.get(DROP, None)
    if drop:
        spark.conf.set(DROP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop:
            spark.conf.unset(DROP) if before is None else spark.conf.set(DROP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``settled`` table that no later step reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(counts: DataFrame, group: str, order: str, measures: list[str]) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum by ``order``) and ``all_<m>`` per group.

    ``counts`` holds one row per (group, order value), already aggregated, and
    few groups (one per profiled column). A plain window would sort a whole
    group in one task. Here every group is cut at its own quantiles, each slice
    gets its own window, and slice offsets, at most groups x slices rows, are
    broadcast back.
    """
    slices = parallelism(counts.sparkSession)
    # Reading every measure here keeps both users of `counts` on one shuffle.
    live = counts.filter(
        F.col(group).isNotNull() & F.col(order).isNotNull() & (reduce(lambda a, b: a + b, map(F.col, measures)) >= 0)
    )
    points = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = live.groupBy(group).agg(F.percentile_approx(order, points, F.lit(10_000)).alias("_cuts"))
    sliced = _count_below(live.join(F.broadcast(cuts), group), "_cuts", order, slices, "_slice").drop("_cuts")

    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = (
        sliced.groupBy(group, "_slice")
        .agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
        .select(
            group,
            "_slice",
            *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
            *[F.sum(f"_s_{m}").over(whole).alias(f"all_{m}") for m in measures],
        )
    )
    within = Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(F.broadcast(offsets), [group, "_slice"])
        .select(
            *counts.columns,
            *[(F.sum(m).over(within) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
            *[f"all_{m}" for m in measures],
        )
    )


def _count_below(df: DataFrame, cuts: str, value: str, slices: int, name: str) -> DataFrame:
    """Number of sorted cut points below a value, by halving; ``slices`` is a power of two."""
    step = slices // 2
    df = df.withColumn(name, F.lit(0))
    while step:
        probe = F.get(F.col(cuts), F.col(name) + (step - 1))
        df = df.withColumn(name, F.col(name) + F.when(probe < F.col(value), step).otherwise(0))
        step //= 2
    return df


def dense_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """0-based position of every row in the given total order, without one global window.

    The range-sorted rows are written to the shared folder once, so the
    partition layout the positions rest on cannot change under a retry. The
    broadcast side has one row per partition.
    """
    placed = settled(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_off"))
        .drop("_at", "_part", "_off")
    )


def lookup_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of many rows with one row per key, both read once.

    ``per_key`` usually ends in a grouping by the same keys and would join in
    place; then Spark cannot split a hot key's rows. Dealing it out evenly first
    gives both sides an exchange of the join's own, which the adaptive skew join splits.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(per_key.repartition(slices), keys)


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], value: str, before: str | None = None, after: str | None = None
) -> DataFrame:
    """``lag`` and ``lead`` of a value within ``keys`` by ``order``, without sorting a key in one task.

    Rows are range-sorted by key and order together, so even one key spreads
    over all partitions; only the outer rows of each partition are handed to
    its neighbours. The sorted rows are checkpointed to keep the layout fixed.
    """
    shared_dir(df.sparkSession)
    placed = df.orderBy(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    here = F.struct(*keys, F.col(value).alias("_v"))
    place = F.struct(*keys, *order)
    edges = placed.groupBy("_part").agg(F.max_by(here, place).alias("_tail"), F.min_by(here, place).alias("_head"))
    parts = Window.orderBy("_part")  # one row per partition
    handed = edges.select("_part", F.lag("_tail").over(parts).alias("_left"), F.lead("_head").over(parts).alias("_right"))
    within = Window.partitionBy("_part").orderBy(*keys, *order)
    out = placed.join(F.broadcast(handed), "_part")
    for name, near, far in ((before, F.lag(here), "_left"), (after, F.lead(here), "_right")):
        if name is None:
            continue
        out = out.withColumn("_near", F.coalesce(near.over(within), F.col(far)))
        same = reduce(lambda a, b: a & b, [F.col(f"_near.{k}").eqNullSafe(F.col(k)) for k in keys], F.lit(True))
        out = out.withColumn(name, F.when(F.col("_near").isNotNull() & same, F.col("_near._v"))).drop("_near")
    return out.drop("_part", "_left", "_right")
