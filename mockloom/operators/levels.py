"""Order of tables by their foreign keys, over whole catalogues: layers are peeled off edge tables, cycles found by colouring.

Every step works on rows (document, table) and (document, child, parent), so a
document of very many tables is spread like many small ones. What is left after a
step is written, which keeps plans short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.operators.fidelity import settled


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, name, colour): the smallest start colour that reaches each node along (doc, a, b) edges; ``start`` covers all nodes, null where there is none."""
    now = start
    while True:
        told = edges.join(now.where("colour is not null").select("doc", F.col("name").alias("a"), "colour"), ["doc", "a"])
        told = told.groupBy("doc", F.col("b").alias("name")).agg(F.min("colour").alias("told"))
        better = F.least("colour", "told")  # skips nulls
        after = settled(now.join(told, ["doc", "name"], "left").select("doc", "name", better.alias("colour"), (~better.eqNullSafe(F.col("colour"))).alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def source_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, name, least): members of cycles that no other node leads into, and the smallest name of each.

    ``edges`` is (doc, child, parent) where every node left has a parent. Forwards,
    each node gets the smallest name that leads to it; who keeps its own is
    the root of a component, made of the nodes of that colour that lead back to the root.
    """
    forward = edges.select("doc", F.col("parent").alias("a"), F.col("child").alias("b"))
    colours = _reached(nodes.select("doc", "name", F.col("name").alias("colour")), forward)
    of = lambda end: colours.select("doc", F.col("name").alias(end), F.col("colour").alias(f"{end}_colour"))
    inside = forward.join(of("a"), ["doc", "a"]).join(of("b"), ["doc", "b"]).where("a_colour = b_colour")
    back = settled(inside.select("doc", F.col("b").alias("a"), F.col("a").alias("b")))
    start = colours.select("doc", "name", F.when(F.col("name") == F.col("colour"), F.col("colour")).alias("colour"))
    members = _reached(start, back).where("colour is not null").select("doc", "name", F.col("colour").alias("least"))
    component = lambda end: members.select("doc", F.col("name").alias(end), F.col("least").alias(f"{end}_least"))
    entered = edges.join(component("child"), ["doc", "child"]).join(component("parent"), ["doc", "parent"], "left")
    entered = entered.where(~F.col("child_least").eqNullSafe(F.col("parent_least"))).select("doc", F.col("child_least").alias("least")).distinct()
    return members.join(entered, ["doc", "least"], "left_anti").select("doc", "name", "least")


def levels(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, name, level): the longest path of parents above each node.

    ``nodes`` is (doc, name), ``edges`` (doc, child, parent); both distinct, edges
    between nodes. Nodes without an unplaced parent are placed, one layer a round.
    Where only cycles are left, the smallest name of each cycle that nothing else leads
    into is placed, without regard to its parents there; with ``strict`` that is an
    error that names the tables of a cycle. Rounds follow the longest path.
    """
    left = settled(nodes.select("doc", "name", F.lit(0).alias("level")))
    edges = settled(edges.select("doc", "child", "parent"))
    placed = []
    while not left.isEmpty():
        waiting = edges.select("doc", F.col("child").alias("name")).distinct()
        ready = settled(left.join(waiting, ["doc", "name"], "left_anti"))
        if ready.isEmpty():
            cycles = settled(source_cycles(left, edges))
            if strict:
                doc, least = cycles.select("doc", "least").orderBy("doc", "least").first()
                some = cycles.where((F.col("doc") == doc) & (F.col("least") == least)).orderBy("name").limit(21).collect()
                names = ", ".join(r["name"] for r in some[:20]) + (" and more" if len(some) > 20 else "")
                raise ValueError(f"foreign keys form a cycle among {names}")
            ready = settled(left.join(cycles.where("name = least").select("doc", "name"), ["doc", "name"], "left_semi"))
        placed.append(ready)
        done = ready.select("doc", F.col("name").alias("parent"), F.col("level").alias("above"))
        told = edges.join(done, ["doc", "parent"]).groupBy("doc", F.col("child").alias("name")).agg((F.max("above") + 1).alias("told"))
        gone = ready.select("doc", "name")
        edges = settled(edges.join(done.select("doc", "parent"), ["doc", "parent"], "left_anti").join(gone.withColumnRenamed("name", "child"), ["doc", "child"], "left_anti"))
        left = settled(left.join(gone, ["doc", "name"], "left_anti").join(told, ["doc", "name"], "left").select("doc", "name", F.greatest("level", "told").alias("level")))
    return _union(placed) if placed else nodes.select("doc", "name", F.lit(0).alias("level"))
