"""Synthesis of table sets in which children follow their parents.

Bottom up, each child table leaves two things with its parent: how many children
every parent has, and where the normal scores of its children lie on average.
These become columns of the parent's own copula. Top down, synthetic parents
draw them with their other columns, and each child is drawn around what its
parent drew. What is left within a parent is one covariance for the child table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.functions.rng import normals
from mockloom.operators import copula
from mockloom.operators.fidelity import settled
from mockloom.operators.generate import Draws
from mockloom.operators.scan import running_totals

#: Children made from one row; a parent with more is cut and spread first.
CHUNK = 10_000


@dataclass(frozen=True)
class Edge:
    """A foreign key by which the rows of ``child`` belong to those of ``parent``."""

    child: str
    fk: str
    parent: str
    key: str

    def column(self, what: int | str) -> str:
        return f"_{self.child}__{self.fk}__{what}"


@dataclass
class TableModel:
    """Copula of a table with the columns its children left; for a child, also its place around a parent."""

    copula: copula.CopulaModel
    columns: list[str]
    edge: Edge | None = None
    #: Modelled columns with a parent's part: number to (mean score, standard deviation, that of the parent's part).
    between: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: Rows without parent for each row with one.
    without: float = 0.0


def split_variance(n: np.ndarray, s: np.ndarray, x: np.ndarray, ssb: np.ndarray, rows: float, squares: float, parents: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariance between and within parents, by the moments of a one-way layout.

    ``n``, ``s``, ``x`` are pairwise numbers, sums and products of scores, ``ssb`` the
    products of parents' means about the whole mean, weighted by children; ``rows``
    children of ``parents`` parents, ``squares`` the sum of squared numbers of children.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.nan_to_num(x / n - (s / n) * (s / n).T)
    if parents < 2:
        return np.zeros_like(total), total
    if rows <= parents:  # one child each: all there is differs between parents
        return total, np.zeros_like(total)
    within = (rows * total - ssb) / (rows - parents)
    between = (ssb / (parents - 1) - within) / ((rows - squares / rows) / (parents - 1))
    none = np.diag(between) <= 0
    between[none], between[:, none] = 0, 0
    within = total - between
    low = np.maximum(np.diag(within), 0)
    within[np.diag_indices_from(within)] = low
    return between, within


def _root(matrix: np.ndarray) -> np.ndarray:
    """Lower triangle whose square is the nearest covariance."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    fixed = vectors @ np.diag(np.maximum(values, 0)) @ vectors.T
    scale = np.sqrt(np.maximum(np.diag(matrix), 0) / np.maximum(np.diag(fixed), 1e-12))
    fixed = fixed * np.outer(scale, scale)
    return np.linalg.cholesky(fixed + np.eye(len(fixed)) * 1e-10)


def augment(edge: Edge, model: copula.CopulaModel, children: DataFrame) -> tuple[TableModel, DataFrame]:
    """The child's model around its parents, and (fk, number of children, mean scores) of each parent.

    A mean over few children is too wide by the spread within a parent. It is
    drawn together to the spread that parents have themselves, by the share of it in
    the mean's own variance.
    """
    d, scores = len(model.modelled), copula.scorer(model)
    names = [f"z{i}" for i in range(d)]

    def score(batches):
        import pandas

        for frame in batches:
            z = pandas.DataFrame(scores(frame), columns=names)
            z.insert(0, "_fk", frame["_fk"].to_numpy())
            yield z

    keyed = children.where(F.col(edge.fk).isNotNull())
    kind = children.schema[edge.fk].dataType.simpleString()
    scored = copula.as_shares(model, keyed.withColumn("_fk", F.col(edge.fk)), "_fk").mapInPandas(score, ", ".join([f"_fk {kind}", *[f"{z} double" for z in names]]))
    means = [F.avg(F.when(~F.isnan(z), F.col(z))).alias(z) for z in names]  # NaN where unknown
    per = settled(scored.groupBy("_fk").agg(F.count(F.lit(1)).alias("_n"), *means))
    n, s, _, x = copula.score_sums(model, keyed)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.nan_to_num(np.diag(s) / np.diag(n))

    def products(batches):
        import numpy
        import pandas

        for frame in batches:
            c = numpy.nan_to_num(frame[names].to_numpy(dtype=float) - mean)
            w = frame["_n"].to_numpy(dtype=float)
            yield pandas.DataFrame({"cell": numpy.arange(d * d), "x": ((c * w[:, None]).T @ c).ravel()})

    cells = per.mapInPandas(products, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").collect()  # d x d rows
    ssb = np.array([r["x"] for r in cells] or np.zeros(d * d)).reshape(d, d)
    rows, squares, parents, all_rows = (*per.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_n")), F.count(F.lit(1))).first(), children.count())
    between, within = split_variance(n, s, x, ssb, float(rows or 0), float(squares or 0), parents)
    spread = np.sqrt(np.maximum(np.diag(between) + np.diag(within), 1e-12))
    model.factor = _root(within) / spread[:, None]
    parts = {i: (float(mean[i]), float(spread[i]), float(np.sqrt(between[i, i]))) for i in range(d) if between[i, i] > 0}
    share = {i: F.sqrt(F.lit(float(between[i, i])) / (F.lit(float(between[i, i])) + F.lit(float(within[i, i])) / F.col("_n"))) for i in parts}
    drawn = [(F.lit(m) + (F.coalesce(f"z{i}", F.lit(m)) - m) * share[i]).alias(edge.column(i)) for i, (m, _, _) in parts.items()]
    table = per.select(F.col("_fk").alias(edge.fk), F.col("_n").alias(edge.column("n")), *drawn)
    return TableModel(model, children.columns, edge, parts, (all_rows - rows) / rows if rows else 0.0), table


def fit(tables: Mapping[str, DataFrame], edges: Sequence[Edge], skip: Mapping[str, Sequence[str]]) -> dict[str, TableModel]:
    """Models of a table set, children first. Each child has one edge; parents come before children in ``tables``; ``skip`` names each table's keys."""
    out, left = {}, {}
    for name in reversed(list(tables)):
        df, counts = tables[name], []
        columns = df.columns
        for edge in (e for e in edges if e.parent == name):
            more = left[edge].withColumnRenamed(edge.fk, "_of")
            df = df.join(more, F.col(edge.key) == F.col("_of"), "left").withColumn(edge.column("any"), F.col("_of").isNotNull().cast("int")).drop("_of")
            counts += [edge.column("n"), edge.column("any")]
        model = copula.fit(df, skip=skip.get(name, ()), fine=counts)
        # whether there are children is a column of its own; how many, and their means, are drawn as those of parents with some
        model.nulls = {c: r for c, r in model.nulls.items() if c in columns}
        own = next((e for e in edges if e.child == name), None)
        if own is None:
            out[name] = TableModel(model, columns)
        else:
            out[name], left[own] = augment(own, model, df)
            out[name].columns = columns
    return {name: out[name] for name in tables}


def _children(parents: DataFrame, model: TableModel, partitions: int) -> tuple[DataFrame, int]:
    """(_row, _parent, _b<i>) of every child that parents drew, numbered from 1 in the parents' order; and their number."""
    edge = model.edge
    number = F.when(F.col(edge.column("any")) > 0, F.col(edge.column("n"))).otherwise(0).cast("bigint")
    drawn = parents.select(F.lit("").alias("_all"), F.col(edge.key).alias("_parent"), number.alias("_n"), *[F.col(edge.column(i)).alias(f"_b{i}") for i in model.between])
    placed = running_totals(drawn, "_all", "_parent", ["_n"]).where("_n > 0")
    placed = placed.withColumn("_first", F.col("cum__n") - F.col("_n"))
    total = parents.agg(F.sum(number)).first()[0] or 0
    chunks = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))))
    chunks = chunks.repartition(partitions, "_parent", "_chunk")
    begin = F.col("_chunk") * CHUNK
    ordinal = F.explode(F.sequence(begin + 1, F.least(F.col("_n"), begin + CHUNK)))
    rows = chunks.select("_parent", "_first", *[f"_b{i}" for i in model.between], ordinal.alias("_o"))
    return rows.select((F.col("_first") + F.col("_o")).alias("_row"), "_parent", *[f"_b{i}" for i in model.between]), total


def sample(spark: SparkSession, models: Mapping[str, TableModel], sizes: Mapping[str, int], keys: Mapping[str, Mapping[str, tuple[str, str] | None]], seed: int | str = 42) -> dict[str, DataFrame]:
    """A synthetic table set, parents first.

    ``sizes`` gives the rows of tables without an edge; others are as large as
    their parents ask. ``keys`` maps a table's key columns to None (numbered from
    1), or to (table, column) of another synthetic table, whose row is drawn evenly;
    the edge's own foreign key is its parent's key. Primary keys of parents are numbers, or those as text.
    """
    made: dict[str, DataFrame] = {}
    rows_of: dict[str, int] = {}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, model in models.items():
        row = F.col("_row")
        shifts, own = {}, {}
        if model.edge is None:
            rows_of[name] = sizes[name]
            base = spark.range(1, sizes[name] + 1, 1).withColumnRenamed("id", "_row")
        else:
            base, with_parent = _children(made[model.edge.parent], model, partitions)
            without = int(round(with_parent * model.without))
            rows_of[name] = with_parent + without
            if without:
                lone = spark.range(with_parent + 1, rows_of[name] + 1, 1).withColumnRenamed("id", "_row")
                base = base.unionByName(lone, allowMissingColumns=True)
            alone = normals(seed, f"{name}-alone", row, len(model.between))
            for (i, (mean, spread, part)), drawn in zip(model.between.items(), alone, strict=True):
                shifts[model.copula.modelled[i]] = F.coalesce((F.col(f"_b{i}") - mean) / spread, drawn * (part / spread))
            own[model.edge.fk] = F.col("_parent")
        for column, target in keys.get(name, {}).items():
            if column in own:
                continue
            if target is None:
                own[column] = row
            elif rows_of.get(target[0]):
                own[column] = Draws(seed, name, column, row).whole(rows_of[target[0]]) + 1
            else:
                own[column] = Draws(seed, name, column, row).whole(100) + 1  # unknown parent
        whole = model.copula.draw(base, seed, own, shifts, name)
        made[name] = settled(whole) if any(m.edge and m.edge.parent == name for m in models.values()) else whole
    return {name: df.select(*models[name].columns) for name, df in made.items()}
