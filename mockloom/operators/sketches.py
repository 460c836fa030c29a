"""Audits of tables that grow: each batch leaves a mergeable sketch, and later audits read sketches only.

A sketch is one row for each numeric column: exact counts, sums and range, and
a KLL sketch of the values, some tens of kilobytes however many rows it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of a KLL sketch, and quantiles of either side at which two sketches are compared.
K, POINTS = 2048, 2048
#: Rank error of a sketch of size K, reached with 99 % confidence: about 2.446 / K ** 0.9433.
RANK_ERROR = 2.446 / K**0.9433


def ks_error(points: int = POINTS) -> float:
    """How far a statistic of two sketches may be from the exact one: a rank error and a step between quantiles on either side."""
    return 2 * RANK_ERROR + 2 / points


def sketch(batch: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column in one pass with map-side combination; nulls and NaN are counted as nulls."""
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("nulls"), F.min(v).alias("low"), F.max(v).alias("high"),
            F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.kll_sketch_agg_double(v, F.lit(K)).alias("kll"),
        )
        for c, v in zip(cols, known, strict=True)
    ]
    return batch.agg(F.array(*per_column).alias("_columns")).select(F.inline("_columns"))


def append_sketch(batch: DataFrame, cols: list[str], store: str, number: int) -> None:
    """File the sketch of one batch; the same number again replaces it. No earlier batch is read."""
    sketch(batch, cols).coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")


def merged(spark: SparkSession, store: str) -> DataFrame:
    """Sketches of all batches as one row per column; the input grows with batches and columns, not rows."""
    rows = spark.read.parquet(store)
    return rows.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.kll_merge_agg_double("kll", F.lit(K)).alias("kll"),
    )


def sketched_statistics(sketches: DataFrame) -> DataFrame:
    """Counts, range, mean and sample deviation, and the median within the rank error; null for a column without values."""
    mean = F.try_divide("total", "n")
    spread = F.try_divide(F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * mean), F.col("n") - 1)
    middle = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(0.5)))
    deviation = F.when((F.col("n") > 1) & (F.col("low") == F.col("high")), 0.0).otherwise(F.sqrt(spread))
    return sketches.select("column_name", "n", "nulls", "low", "high", mean.alias("mean"), deviation.alias("deviation"), middle.alias("median"))


def sketched_ks(real: DataFrame, synth: DataFrame, points: int = POINTS) -> DataFrame:
    """Largest gap of the distribution functions per column, within ``ks_error(points)``; columns empty on a side are left out."""
    side = lambda df, name: df.filter("n > 0").select("column_name", F.col("kll").alias(name), F.col("n").alias(f"n_{name}"))
    both = side(real, "real").join(side(synth, "synth"), "column_name")
    # of the quantiles at 1/points, 2/points.. as many lie at or below a value as its share of the rows reaches
    ranks = F.array(*[F.lit(i / points) for i in range(1, points + 1)])  # Spark takes constants only
    marks = [both.select("column_name", F.explode(F.kll_sketch_get_quantile_double(s, ranks)).alias("value"), F.lit(sign).alias("sign"))
             for s, sign in (("real", 1), ("synth", -1))]
    steps = marks[0].unionByName(marks[1]).groupBy("column_name", "value").agg(F.sum("sign").alias("step"))
    upto = Window.partitionBy("column_name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 * points rows
    gaps = steps.withColumn("gap", F.abs(F.sum("step").over(upto))).groupBy("column_name").agg((F.max("gap") / points).alias("statistic"))
    return gaps.join(both.select("column_name", "n_real", "n_synth"), "column_name")
