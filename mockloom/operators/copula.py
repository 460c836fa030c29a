"""Gaussian copula: fit on a table, sample any number of rows; child counts per parent.

Numbers, dates and timestamps are modelled by quantile grids, everything else by
the shares of its values, however many there are: these stay a table, which
fitting and sampling join. Only grids (columns x points) and a columns x columns
matrix reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.functions import normal as gauss
from mockloom.functions.rng import normal_bits, normals_of, uniform
from mockloom.operators.fidelity import settled
from mockloom.operators.generate import Draws
from mockloom.operators.scan import dense_index, running_totals
from mockloom.operators.slices import Slices, local_rows, values_at

GRID = 32  # quantile steps per numeric column
FINE = 512  # steps for columns of which no value between two known ones may appear
BROADCAST = 10_000  # values of a text column up to which their stretches are sent to all tasks
EDGE = 1e-6


TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _on_grid(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, *TEMPORAL))


def _plain(field: T.StructField) -> Column:
    """The column as a number (days or microseconds for times) or as text."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        c = F.unix_date(c)
    elif isinstance(field.dataType, TEMPORAL):
        c = F.unix_micros(c.cast("timestamp"))
    return c.cast("double" if _on_grid(field) else "string").alias(field.name)


def _restored(value: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.DateType):
        value = F.date_from_unix_date(F.round(value).cast("int"))
    elif isinstance(field.dataType, TEMPORAL):
        value = F.timestamp_micros(F.round(value).cast("long"))
    elif isinstance(field.dataType, T.IntegralType):
        value = F.round(value)
    return value.cast(field.dataType)


def marginals(df: DataFrame, cols: list[str], steps: int = GRID) -> DataFrame:
    """Exact quantiles of numeric columns at 0, 1/steps, ..., 1."""
    slices = Slices([df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])])
    sizes = [int(c.sum()) for c in slices.counts]
    ranks = [np.array([max(1, math.ceil(i / steps * n)) for i in range(steps + 1 if n else 0)], dtype=np.int64) for n in sizes]
    rows = [(c, *found) for c, *found in zip(cols, values_at(slices, ranks), sizes, strict=True) if found[1]]
    return local_rows(df.sparkSession, rows, "column_name string, quantiles array<double>, n_values bigint")


def null_rates(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def category_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, low, high): the stretch of [0, 1) that each text value takes, in hash order."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value").dropna()
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.xxhash64("value"))
    placed = running_totals(counts, "column_name", "place", ["n"])
    low, high = F.col("cum_n") - F.col("n"), F.col("cum_n")
    return placed.select("column_name", "value", (low / F.col("all_n")).alias("low"), (high / F.col("all_n")).alias("high"))


@dataclass
class CopulaModel:
    """Fitted copula. ``sample`` gives the same rows for the same seed, however partitioned."""

    schema: T.StructType
    grids: dict[str, list[float]]
    #: (column_name, value, low, high) of the columns named in ``texts``.
    shares: DataFrame | None
    texts: list[str]
    nulls: dict[str, float]
    modelled: list[str]
    factor: np.ndarray
    #: Columns whose grid points are drawn as they are.
    fine: Sequence[str] = ()
    #: Number of values of each column of ``texts``.
    values: Mapping[str, int] = field(default_factory=dict)

    def sample(
        self, spark: SparkSession, n: int, seed: int | str = 42, partitions: int | None = None, keys: Mapping[str, Column] | None = None
    ) -> DataFrame:
        """``keys`` gives columns that are not drawn but computed from the row id ``_row`` (1, 2, ...)."""
        return self.draw(spark.range(1, n + 1, 1, partitions).withColumnRenamed("id", "_row"), seed, keys)

    def draw(self, base: DataFrame, seed: int | str = 42, keys: Mapping[str, Column] | None = None, shifts: Mapping[str, Column] | None = None, name: str = "copula") -> DataFrame:
        """One row for each of ``base``, numbered by its column ``_row``; ``keys`` and ``shifts``
        are columns of ``base``. A shift is added to the normal score of a column."""
        row, keys = F.col("_row"), keys or {}
        shifts = {self.modelled.index(c): shift for c, shift in (shifts or {}).items()}
        bits = normal_bits(seed, name, row, len(self.modelled))
        given = base.select("*", *[h.alias(f"_h{k}") for k, h in enumerate(bits)], *[shift.cast("double").alias(f"_s{i}") for i, shift in shifts.items()])
        wanted = [(i, c) for i, c in enumerate(self.modelled) if c not in keys]
        kept = len(base.columns)
        schema = T.StructType([*base.schema.fields, *[T.StructField(f"_u{i}" if c in self.texts else f"_v{i}", T.DoubleType()) for i, c in wanted]])
        placed = given.mapInArrow(self._drawer(kept, len(bits), list(shifts), wanted), schema)
        for _, c in wanted:
            if c in self.texts:
                placed = self._looked_up(placed, c)
        out = []
        for field in self.schema:
            value = keys.get(field.name)
            if value is None:
                value = _restored(self._value(field), field)
                rate = self.nulls.get(field.name, 0.0)
                if rate > 0:
                    value = F.when(uniform(seed, f"{name}-null", field.name, row) >= rate, value)
            out.append(value.cast(field.dataType).alias(field.name))
        return placed.select(*out)

    def _drawer(self, kept: int, hashes: int, shifted: list[int], wanted: list[tuple[int, str]]):
        """Function of Arrow batches with ``kept`` columns, hashes and shifts: the kept ones, the share in [0, 1) of each text and the value on each grid.

        As one Spark expression this is a method that Java never compiles, so that each row takes ten times as long.
        """
        d, factor, fine = len(self.modelled), np.asarray(self.factor, dtype=float), set(self.fine)
        grids = {i: np.asarray(self.grids[c], dtype=float) for i, c in wanted if c in self.grids and c not in self.texts}
        points = {i: c in fine for i, c in wanted}
        normals, cdf = normals_of(d), gauss.cdf_of()

        def draw(batches):
            import numpy
            import pyarrow

            for batch in batches:
                column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
                scores = normals([column(kept + k) for k in range(hashes)])
                out = []
                for i, _ in wanted:
                    z = column(kept + hashes + shifted.index(i)) if i in shifted else numpy.zeros(batch.num_rows)
                    for k in range(i + 1):
                        if factor[i, k]:
                            z = z + scores[k] * factor[i, k]
                    u = numpy.minimum(numpy.maximum(cdf(z), 0.0), 1.0 - 1e-12)
                    if i in grids:
                        grid, x = grids[i], u * (len(grids[i]) - 1)
                        if points[i]:
                            u = grid[numpy.ceil(x).astype(int)]
                        else:
                            at = numpy.floor(x).astype(int)
                            u = grid[at] + (grid[at + 1] - grid[at]) * (x - at)
                    out.append(pyarrow.array(u))
                names = [*batch.schema.names[:kept], *[f"_v{i}" if i in grids else f"_u{i}" for i, _ in wanted]]
                yield pyarrow.RecordBatch.from_arrays([*batch.columns[:kept], *out], names=names)

        return draw

    def _looked_up(self, placed: DataFrame, name: str) -> DataFrame:
        """Add ``_t_<name>``: the value in whose stretch the drawn share lies, met by equal slices of [0, 1).

        There are as many slices as values or more. Draws are spread evenly over
        them, so a draw meets two or three stretches on average, however many values there are.
        """
        u = F.col(f"_u{self.modelled.index(name)}")
        spans = self.shares.filter(F.col("column_name") == name)
        values = self.values[name]
        slices = 1 << max(values - 1, 1).bit_length()
        cells = F.sequence(F.floor(F.col("low") * slices), F.least(F.floor(F.col("high") * slices), F.lit(slices - 1)))
        spans = spans.select(F.col("value").alias(f"_t_{name}"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.explode(cells).alias("_cell"))
        # never null, as Spark says by it: else it adds a filter that repeats the whole expression of the draw
        met = placed.withColumn("_cell", F.coalesce(F.floor(u * slices), F.lit(0))).join(F.broadcast(spans) if values <= BROADCAST else spans, "_cell")
        return met.filter((u >= F.col("_low")) & (u < F.col("_high"))).drop("_cell", "_low", "_high")

    def _value(self, field: T.StructField) -> Column:
        name = field.name
        if name in self.texts:
            return F.col(f"_t_{name}")
        if name not in self.grids:
            return F.lit(None)
        return F.col(f"_v{self.modelled.index(name)}")


def fit(df: DataFrame, steps: int = GRID, skip: Sequence[str] = (), fine: Sequence[str] = ()) -> CopulaModel:
    """Fit marginals and correlation of all columns but those in ``skip``, which are sampled as null.

    Columns in ``fine`` get FINE steps, and no values between those known.
    """
    fields = [f for f in df.schema if f.name not in skip]
    plain = df.select(*[_plain(f) for f in fields])
    numbers = [f.name for f in fields if _on_grid(f)]
    texts = [f.name for f in fields if not _on_grid(f)]
    coarse = [c for c in numbers if c not in fine]
    grids = {r["column_name"]: list(r["quantiles"]) for r in marginals(plain, coarse, steps).collect()} if coarse else {}
    if fine:
        probs = [i / FINE for i in range(FINE + 1)]
        row = plain.agg(*[F.percentile_approx(c, probs, 100 * FINE).alias(c) for c in fine]).first()
        grids |= {c: list(row[c]) for c in fine if row[c] is not None}
    nulls = null_rates(plain) if fields else {}
    texts = [c for c in texts if nulls[c] < 1.0 and plain.filter(F.col(c).isNotNull()).limit(1).count()]
    shares = settled(category_shares(plain, texts)) if texts else None
    values = {r["column_name"]: r["count"] for r in shares.groupBy("column_name").count().collect()} if texts else {}
    modelled = [f.name for f in fields if f.name in grids or f.name in texts]
    model = CopulaModel(df.schema, grids, shares, texts, nulls, modelled, np.eye(len(modelled)), fine, values)
    if len(modelled) > 1:
        model.factor = _factor(correlation(*score_sums(model, df)))
    return model


def as_shares(model: CopulaModel, df: DataFrame, *keep: str) -> DataFrame:
    """The modelled columns as numbers: those on a grid as they are, a text as the middle of its stretch. ``keep`` stays beside them."""
    fields = {f.name: f for f in df.schema}
    df = df.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], *[_plain(fields[c]) for c in model.modelled])
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name in model.texts:
        middle = model.shares.filter(F.col("column_name") == name).select(F.col("value").alias(name), ((F.col("low") + F.col("high")) / 2).alias("_p"))
        # rows are never dealt out by a column of few values; by one of many, an exchange of the join's own lets Spark split a frequent value
        middle = F.broadcast(middle) if model.values[name] <= BROADCAST else middle.repartition(slices)
        df = df.join(middle, name, "left").withColumn(name, F.col("_p")).drop("_p")
    return df.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], *model.modelled)


def scorer(model: CopulaModel):
    """Function of a Pandas frame of ``as_shares``: normal scores, a column for each modelled one, NaN where unknown."""
    modelled, edge = list(model.modelled), EDGE
    spans = {c: np.asarray(model.grids[c], dtype=float) for c in modelled if c in model.grids}
    a, b, c, e = gauss.INV_A, gauss.INV_B, gauss.INV_C, gauss.INV_D

    def scores(frame):
        import numpy

        z = numpy.full((len(frame), len(modelled)), numpy.nan)
        for i, name in enumerate(modelled):
            p = frame[name].to_numpy(dtype=float, na_value=numpy.nan)
            if name in spans:
                grid, x = spans[name], p
                low, high = numpy.searchsorted(grid, x, "left"), numpy.searchsorted(grid, x, "right")
                # a value that several grid points share stands in their middle
                p = numpy.where(high > low, (low + high - 1) / 2, numpy.interp(x, grid, numpy.arange(len(grid)))) / (len(grid) - 1)
                p[numpy.isnan(x)] = numpy.nan
            p = numpy.clip(p, edge, 1 - edge)
            q = p - 0.5
            middle = numpy.polyval(a, q * q) * q / numpy.polyval(b, q * q)
            t = numpy.sqrt(-2 * numpy.log(numpy.minimum(p, 1 - p)))
            tail = numpy.polyval(c, t) / numpy.polyval(e, t)
            z[:, i] = numpy.where(numpy.abs(q) <= 0.47575, middle, numpy.where(q < 0, tail, -tail))
        return z

    return scores


def score_sums(model: CopulaModel, df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over pairwise complete rows: their number, and sums of the normal scores, of their squares and of their products.

    Each Arrow batch is scored with NumPy and leaves only its d x d sums, which
    Spark adds up; rows never leave their task.
    """
    d, scores = len(model.modelled), scorer(model)

    def sums(batches):
        import numpy
        import pandas

        for frame in batches:
            z = scores(frame)
            known = (~numpy.isnan(z)).astype(float)
            z = numpy.nan_to_num(z)
            parts = [known.T @ known, z.T @ known, (z * z).T @ known, z.T @ z]
            yield pandas.DataFrame(
                {"cell": numpy.arange(d * d), **{k: m.ravel() for k, m in zip(("n", "s", "q", "x"), parts)}}
            )

    partial = as_shares(model, df).mapInPandas(sums, "cell int, n double, s double, q double, x double")
    rows = partial.groupBy("cell").agg(*[F.sum(k).alias(k) for k in ("n", "s", "q", "x")]).orderBy("cell").collect()  # d x d rows
    return tuple(np.array([r[k] for r in rows] if rows else np.zeros(d * d)).reshape(d, d) for k in ("n", "s", "q", "x"))


def correlation(n: np.ndarray, s: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt(n * q - s * s)
        r = (n * x - s * s.T) / (spread * spread.T)
    r = np.where(np.isfinite(r), np.clip(r, -1, 1), 0.0)
    np.fill_diagonal(r, 1.0)
    return r


def _factor(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor; eigenvalues are lifted where pairwise estimates are not a valid matrix."""
    values, vectors = np.linalg.eigh(matrix)
    fixed = vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / np.outer(scale, scale))


# --- plugins ----------------------------------------------------------------------------


class Generator(Protocol):
    def fit(self, df: DataFrame, parameters: dict | None = None) -> "Generator": ...

    def generate(self, spark: SparkSession, n_rows: int) -> DataFrame: ...


class CopulaPlugin:
    """The copula behind the plugin interface. Parameters: ``steps``, ``seed``."""

    def fit(self, df: DataFrame, parameters: dict | None = None) -> "CopulaPlugin":
        options = parameters or {}
        self.seed = options.get("seed", 42)
        self.model = fit(df, options.get("steps", GRID))
        return self

    def generate(self, spark: SparkSession, n_rows: int) -> DataFrame:
        if getattr(self, "model", None) is None:
            raise ValueError("fit the copula before generating rows")
        return self.model.sample(spark, n_rows, self.seed)


PLUGINS: dict[str, type] = {"copula": CopulaPlugin}


def plugins() -> list[str]:
    """Names of the registered generator plugins."""
    return sorted(PLUGINS)


def plugin(name: str) -> Generator:
    if name.lower() not in PLUGINS:
        raise ValueError(f"no generator plugin is called {name}; there are {', '.join(plugins())}")
    return PLUGINS[name.lower()]()


def model_choice(attributes: DataFrame, *keep: str) -> DataFrame:
    """Model advised per table: many columns, many text columns, or neither."""
    text = ~F.coalesce(F.upper("type"), F.lit("")).isin("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "DECIMAL", "FLOAT", "DOUBLE", "BOOLEAN", "BOOL")
    return attributes.groupBy(*keep, "table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(text).alias("text_columns")
    ).withColumn("model", F.when(F.col("columns") > 15, "ctgan").when(F.col("text_columns") > 5, "vae").otherwise("copula"))


# --- parents and children -----------------------------------------------------------------


def child_counts(parents: DataFrame, key: str, children: DataFrame, fk: str) -> DataFrame:
    """Children per parent, childless parents included."""
    counts = children.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias("children"))
    return parents.select(key).join(counts, key, "left").select(key, F.coalesce("children", F.lit(0)).alias("children"))


def cardinality_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


def synthetic_counts(counts: DataFrame, key: str, ids: DataFrame, seed=42) -> DataFrame:
    """Child count of each synthetic parent: that of a real parent drawn uniformly."""
    real = dense_index(counts, [key], "_n").drop(key)
    size = max(real.count(), 1)
    drawn = ids.withColumn("_n", Draws(seed, "hma", "children", F.col("id")).whole(size))
    return drawn.join(real, "_n").select("id", "children")


def spread_children(counts: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(parent, ordinal) rows. A parent with very many children is cut into chunks that are spread first."""
    chunks = counts.filter("children > 0").select(
        F.col("id").alias("parent"), "children", F.explode(F.sequence(F.lit(0), F.floor((F.col("children") - 1) / chunk))).alias("_chunk")
    )
    slices = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(slices, "parent", "_chunk")
    first = F.col("_chunk") * chunk + 1
    return spread.select("parent", F.explode(F.sequence(first, F.least(F.col("children"), first + chunk - 1))).alias("ordinal"))
