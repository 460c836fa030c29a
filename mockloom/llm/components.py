"""Connected components by alternating stars; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.llm.store import written
from mockloom.operators.scan import lookup_by_key


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are tied to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return lookup_by_key(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.col("m").alias("v")).union(lookup_by_key(down, least, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; ``component`` is the smallest id reachable.

    A node with very many edges is one row of minima and a join that Spark can
    split. The rounds grow with the logarithm of the nodes. Loops, repeated edges
    and edges both ways do no harm; no edges give no rows.
    """
    edges = edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u != v").distinct()
    before = None
    while True:
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state
