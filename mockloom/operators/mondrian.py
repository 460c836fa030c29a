"""k-anonymity that finds its own generalisation: boxes of at least k rows by splits at exact medians (Mondrian).

All boxes are split at once, one level after the other; boxes of few
combinations are split to the end in one task each. Only distinct
combinations of the quasi-identifiers with their numbers of rows are handled, each column as the
place of its values in order, so numbers, times and texts are treated alike.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mockloom.operators.fidelity import settled
from mockloom.operators.scan import dense_index, lookup_by_key

#: Parts of a stretch of places counted in one pass of the search for medians.
PARTS = 256
#: Combinations of a box up to which one task makes all its splits.
TASK = 20_000


def _coded(df: DataFrame, quasi: list[str]) -> tuple[DataFrame, list[int]]:
    """Distinct combinations with their rows ``n`` and places c0.. (null: 0, then values in order), and the number of places of each column."""
    cells, sizes = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")), []
    cells = settled(cells)
    for i, name in enumerate(quasi):
        values = dense_index(cells.select(name).dropna().distinct(), [name], "_place").select(name, (F.col("_place") + 1).cast("int").alias(f"c{i}"))
        sizes.append(values.count() + 1)
        known = lookup_by_key(cells.where(F.col(name).isNotNull()), values, [name])
        cells = known.unionByName(cells.where(F.col(name).isNull()).withColumn(f"c{i}", F.lit(0)))
    return settled(cells.select(*quasi, "n", *[f"c{i}" for i in range(len(quasi))])), sizes


def _chosen(d: int, at: Column) -> Column:
    return F.element_at(F.array(*[F.col(f"c{i}") for i in range(d)]), at + 1)


def _medians(cells: DataFrame, boxes: DataFrame, d: int, most: int) -> DataFrame:
    """``boxes`` (box, dim, rows, lo, hi) with the exact median place ``lo`` of their column, and the rows below it and at it.

    Each pass counts PARTS parts of the stretch that holds the median, all boxes
    together, and goes on in one of them; a window has at most PARTS rows.
    """
    boxes = boxes.withColumns({"below": F.lit(0).cast("bigint"), "at": F.col("rows")})
    for _ in range(max(1, ceil(log(most + 1) / log(PARTS)))):
        width = F.col("hi") - F.col("lo") + 1
        part = F.floor((F.col("v") - F.col("lo")) * PARTS / width).cast("int")
        inside = lookup_by_key(cells, boxes, ["box"]).withColumn("v", _chosen(d, F.col("dim"))).where("v >= lo and v <= hi")
        counts = inside.groupBy("box", part.alias("part")).agg(F.sum("n").alias("m"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        upto = F.sum("m").over(Window.partitionBy("box").orderBy("part"))
        held = counts.withColumn("upto", upto).join(boxes, "box").where(2 * (F.col("below") + F.col("upto")) >= F.col("rows"))
        best = held.groupBy("box").agg(F.min(F.struct("part", "m", "upto", "least", "greatest")).alias("p"))
        boxes = settled(boxes.join(best, "box").select(
            "box", "dim", "rows", F.col("p.least").alias("lo"), F.col("p.greatest").alias("hi"),
            (F.col("below") + F.col("p.upto") - F.col("p.m")).alias("below"), F.col("p.m").alias("at")))
        if boxes.where("lo < hi").isEmpty():
            break
    return boxes


def _split_up(k: int, sizes: list[int]):
    """All splits of one box of few combinations, by the rules of ``boxes_of``."""
    d, full = len(sizes), [max(s - 1, 1) for s in sizes]

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        c = [table[f"c{i}"].to_numpy() for i in range(d)]
        names, waiting = np.empty(len(n), object), [(np.arange(len(n)), table["box"][0].as_py())]
        while waiting:
            at, box = waiting.pop()
            m, right = n[at], None
            rows = m.sum()
            widths = [(c[i][at].max() - c[i][at].min()) / full[i] for i in range(d)]
            for i in sorted(range(d), key=lambda i: (-widths[i], i)) if rows >= 2 * k else ():
                if widths[i] <= 0:
                    break
                v = c[i][at]
                order = np.argsort(v, kind="stable")
                median = v[order[np.searchsorted(2 * np.cumsum(m[order]), rows)]]
                behind, before = m[v <= median].sum(), m[v < median].sum()
                behind, before = min(behind, rows - behind), min(before, rows - before)
                if max(behind, before) >= k:
                    right = v > median if behind >= before else v >= median
                    break
            if right is None:
                names[at] = box
            else:
                waiting += [(at[~right], box + "0"), (at[right], box + "1")]
        return table.set_column(table.schema.get_field_index("box"), "box", pa.array(names, pa.string()))

    return run


def boxes_of(df: DataFrame, k: int, quasi: list[str]) -> tuple[DataFrame, list[int]]:
    """(quasi.., n, c0.., box) of every distinct combination, and the number of places of each column.

    A box is split at the median of the column in which it is relatively widest,
    next widest if that leaves a side under ``k`` rows, until no column will do. Of the cuts
    before and behind the median the more even one that keeps ``k`` on both sides is taken.
    """
    d = len(quasi)
    cells, sizes = _coded(df, quasi)
    live, done = cells.withColumns({"box": F.lit("r"), "tried": F.lit(0)}), []
    while True:
        ends = [f(f"c{i}").alias(f"{name}{i}") for i in range(d) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        stats = live.groupBy("box", "tried").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"), *ends)
        widths = [F.struct(((F.col(f"hi{i}") - F.col(f"lo{i}")) / max(sizes[i] - 1, 1)).alias("width"), F.lit(-i).alias("dim")) for i in range(d)]
        ranked = F.filter(F.sort_array(F.array(*widths), asc=False), lambda w: w["width"] > 0)
        dim = -F.get(ranked, F.col("tried"))["dim"]
        pick = lambda name: F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(d)]), F.col("dim") + 1)
        open_ = stats.withColumn("dim", dim).where((F.col("cells") > TASK) & (F.col("rows") >= 2 * k) & F.col("dim").isNotNull())
        open_ = settled(open_.select("box", "dim", "rows", pick("lo").alias("lo"), pick("hi").alias("hi")))
        done.append(live.join(open_.select("box"), "box", "left_anti"))
        if open_.isEmpty():
            break
        live = settled(live.join(open_.select("box"), "box", "left_semi"))
        found = _medians(live, open_, d, max(sizes))
        behind, before = F.col("below") + F.col("at"), F.col("below")
        room = lambda left: F.least(left, F.col("rows") - left)
        after = (room(behind) >= room(before)).alias("after")
        cuts = found.select("box", "dim", "lo", after, (F.greatest(room(behind), room(before)) >= k).alias("fits"))
        v = _chosen(d, F.col("dim"))
        right = F.when(F.col("after"), v > F.col("lo")).otherwise(v >= F.col("lo"))
        moved = lookup_by_key(live, cuts, ["box"])
        live = settled(moved.select(
            *cells.columns, F.when(F.col("fits"), F.concat("box", F.when(right, "1").otherwise("0"))).otherwise(F.col("box")).alias("box"),
            F.when(F.col("fits"), 0).otherwise(F.col("tried") + 1).alias("tried")))
    few = reduce(lambda a, b: a.unionByName(b), done).drop("tried")
    final = few.groupBy("box").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") > TASK).select("box")
    # a larger box that came this far cannot be split
    small = few.join(final, "box", "left_anti").select(few.columns)
    split = small.groupBy("box").applyInArrow(_split_up(k, sizes), small.schema)
    return settled(split.unionByName(few.join(final, "box", "left_semi"))), sizes


def loss(cells: DataFrame, group: str | list[str], sizes: list[int]) -> DataFrame:
    """(loss): what a grouping of coded cells gives away, 0 to 1: the mean share of its places that a column's stretch covers, over rows and columns."""
    d = len(sizes)
    spans = cells.groupBy(*([group] if isinstance(group, str) else group)).agg(
        F.sum("n").alias("rows"), *[((F.max(f"c{i}") - F.min(f"c{i}")) / max(sizes[i] - 1, 1)).alias(f"w{i}") for i in range(d)])
    return spans.agg((F.sum(F.col("rows") * sum((F.col(f"w{i}") for i in range(d)), F.lit(0.0))) / (F.sum("rows") * d)).alias("loss"))


def anonymise(df: DataFrame, k: int, quasi: list[str]) -> DataFrame:
    """``df`` with each quasi-identifier replaced by ``<name>_low``, ``<name>_high`` and ``<name>_null`` of its box.

    All rows stay, and each combination of the new columns has ``k`` rows or
    more. A table of fewer than ``k`` rows cannot be released: no row is returned. Nulls stand before all
    values; ``<name>_null`` says whether a box holds any.
    """
    cells = boxes_of(df, k, quasi)[0].select(*quasi, "n", "box")
    ends = [e for c in quasi for e in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), F.bool_or(F.col(c).isNull()).alias(f"{c}_null"))]
    shown = cells.groupBy("box").agg(F.sum("n").alias("_rows"), *ends).where(F.col("_rows") >= k).drop("_rows")
    of_cell = lookup_by_key(cells.select(*quasi, "box"), shown, ["box"]).drop("box")
    rest = [c for c in df.columns if c not in quasi]
    same = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in quasi])
    new = [f"{c}_{e}" for c in quasi for e in ("low", "high", "null")]
    return df.alias("d").join(of_cell.alias("b"), same).select(*[f"d.{c}" for c in rest], *new)
