"""Mixes of sources by weight: how often each document is repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mockloom.llm.store import written

#: Weights of the sources in code point order, repeated (fixed values).
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken this many times at most (fixed value).
MOST = 3
#: Steps in which the drawing threshold of a source is set: three hex digits of a hash.
STEPS = 4096
#: Draws of each document, from one hash; a source uses the one that meets its target best.
DRAWS = 10


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(seed: str, key: Column) -> Column:
    """Hash of a row's id, from which its draws come: a function of seed and id alone."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))


def step(digest: Column, draw: Column | int) -> Column:
    """Uniform step 0..STEPS-1."""
    return F.conv(F.substr(digest, F.lit(3) * draw + 1, F.lit(3)), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): all sizes shared by weight, none above ``most`` times its own.

    Sharing the excess until none is above ends at one level: a source gets its
    weight times the level, or its cap. In the order of cap over weight, the
    level is the first that the source it is computed at does not cut.
    The windows hold one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - before) / left).withColumn("pos", F.row_number().over(by_cap))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("pos", "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, draw, steps) from (source, size, digest): copies of every document, and the draw and threshold for one more.

    The rate of a source is target over size: floor(rate) copies each, and one
    more with the probability of the fraction, by the hash of the document. The
    threshold is set at the step where the drawn sizes come nearest to what is
    missing, about the fraction times STEPS, and of DRAWS hashes the nearest is
    used, so that sources of few or very unequal documents meet their target
    too. At most DRAWS x STEPS rows for each source.
    """
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("int")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    drawn = rows.select("source", "size", "digest", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    per_step = drawn.withColumn("step", step(F.col("digest"), F.col("draw"))).groupBy("source", "draw", "step").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source", "draw").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = per_step.withColumn("upto", F.sum("size").over(upto))
    off = F.abs(F.col("upto") - F.col("missing"))
    best = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).groupBy("g.source", "source_size", "target", "whole", "missing")
    best = best.agg(F.min(F.struct(off.alias("off"), F.col("draw"), (F.col("step") + 1).alias("steps"))).alias("best"))
    steps = F.when(F.col("missing") <= F.col("best.off"), 0).otherwise(F.col("best.steps"))
    return best.select("source", "source_size", "target", "whole", "best.draw", steps.alias("steps"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` in a struct ``mix``; see ``plan``.

    Documents are read once for the sums and once for the copies; their texts are
    shuffled only if the table of sources is too large for Spark to broadcast.
    A null source is a source of its own, the last; a null or empty text has size 0
    and adds nothing; a source of size 0 has target 0 and no copies. Rows with equal
    ids draw alike. Other columns stay, also those named like the ones made here.
    """
    rows = docs.select(docs[source_col].alias("source"), words(docs[text_col]).alias("size"), digest(seed, docs[id_col]).alias("digest"))
    p = written(plan(rows), "mix-plan")  # its size is known from here on: small enough, it is broadcast before any text is shuffled
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    joined = held.join(p, F.col(f"doc.`{source_col}`").eqNullSafe(p["source"]))
    drawn = (step(digest(seed, F.col(f"doc.`{id_col}`")), F.col("draw")) < F.col("steps")).cast("int")
    made = F.struct(words(F.col(f"doc.`{text_col}`")).alias("size"), "source_size", "target", (F.col("whole") + drawn).alias("copies"))
    return joined.select("doc", made.alias("mix"))


def repeated(docs: DataFrame, seed: str = "mix", **columns: str) -> DataFrame:
    """The mixed table itself: the rows of ``docs``, each as often as ``mix`` says."""
    mixed = mix(docs, seed, **columns).where("mix.copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("doc.*")
