"""How close a synthetic table is to a real one.

Every operator reduces both sides to one row per (column, value) first, with
partial aggregation before the only large shuffle, so a value that fills a
third of the table costs one row afterwards.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.functions.tests_math import chi2_pvalue, ks_pvalue
from mockloom.operators.scan import lookup_by_key, running_totals, settled
from mockloom.operators.slices import Slices, largest_gaps, local_rows, values_at

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


# --- column routing ---------------------------------------------------------


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def common_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    return [c for c in real.columns if c in synth.columns]


def numeric_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    return [
        c
        for c in common_columns(real, synth)
        if isinstance(_type(real, c), T.NumericType) and isinstance(_type(synth, c), T.NumericType)
    ]


def text_columns(real: DataFrame, synth: DataFrame, csv_semantics: bool = True) -> list[str]:
    """Category columns. Dates count as text when tables are taken as read from CSV."""
    kinds = (T.StringType, *TEMPORAL) if csv_semantics else (T.StringType,)
    return [c for c in common_columns(real, synth) if isinstance(_type(real, c), kinds)]


# --- shared (column, value) counts -------------------------------------------


def _number(df: DataFrame, name: str) -> Column:
    kind = _type(df, name)
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, TEMPORAL):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def _long(real: DataFrame, synth: DataFrame, cols: list[str], as_text: bool) -> DataFrame:
    def side(df: DataFrame, is_real: int) -> DataFrame:
        picked = df.select(*[(F.col(c).cast("string") if as_text else _number(df, c)).alias(c) for c in cols])
        melted = picked.unpivot([], cols, "column_name", "value")
        keep = F.col("value").isNotNull() if as_text else F.col("value").isNotNull() & ~F.isnan("value")
        return melted.filter(keep).withColumn("in_real", F.lit(is_real))

    return side(real, 1).unionByName(side(synth, 0))


def value_counts(real: DataFrame, synth: DataFrame, cols: list[str], as_text: bool) -> DataFrame:
    """(column_name, value, n_real, n_synth) over the non-null values of both sides."""
    return (
        _long(real, synth, cols, as_text)
        .groupBy("column_name", "value")
        .agg(F.sum("in_real").alias("n_real"), F.sum(1 - F.col("in_real")).alias("n_synth"))
    )


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- numeric columns ----------------------------------------------------------


def ecdf(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Running counts of both sides at every distinct value of every column."""
    counts = value_counts(real, synth, cols, as_text=False)
    return running_totals(counts, "column_name", "value", ["n_real", "n_synth"])


def ks_statistic(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Largest gap between the two empirical distribution functions per column."""
    if not cols:
        return _empty(real.sparkSession, "column_name string, statistic double, n_real bigint, n_synth bigint")
    gap = F.abs(
        F.try_divide(F.col("cum_n_real"), F.col("all_n_real")) - F.try_divide(F.col("cum_n_synth"), F.col("all_n_synth"))
    )
    return (
        ecdf(real, synth, cols)
        .groupBy("column_name")
        .agg(F.max(gap).alias("statistic"), F.max("all_n_real").alias("n_real"), F.max("all_n_synth").alias("n_synth"))
    )


def _ks_largest(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """The same figures at once, from counts between cuts: only values between the cuts where the gap may be largest are sorted."""
    both = Slices([df.select(*[_number(df, c).alias(f"c{i}") for i, c in enumerate(cols)]) for df in (real, synth)])
    rows = [(c, *found) for c, found in zip(cols, largest_gaps(both), strict=True) if found[1] or found[2]]
    return local_rows(real.sparkSession, rows, "column_name string, statistic double, n_real bigint, n_synth bigint")


def _verdict(frame: DataFrame) -> DataFrame:
    alike = F.col("p_value") > 0.05
    # fixed values: the two readings of a test
    return frame.withColumn("similar_distribution", alike).withColumn(
        "interpretation", F.when(alike, "Similar distributions").otherwise("Different distributions")
    )


def ks_test(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Two-sample KS test of every numeric column; columns empty on a side are left out."""
    stats = ks_statistic(real, synth, numeric_columns(real, synth)).filter("n_real > 0 and n_synth > 0")
    return _verdict(stats.withColumn("p_value", ks_pvalue(F.col("statistic"), F.col("n_real"), F.col("n_synth"))))


def _deviation(c: Column) -> Column:
    """Sample deviation, exactly zero for a constant."""
    return F.when((F.count(c) > 1) & (F.min(c) == F.max(c)), F.lit(0.0)).otherwise(F.stddev_samp(c))


def basic_statistics(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Mean, sample deviation, range, exact median and count of both sides per numeric column."""
    cols = numeric_columns(real, synth)
    sides = {"real": F.col("in_real") == 1, "synth": F.col("in_real") == 0}
    moments = _long(real, synth, cols, as_text=False).groupBy("column_name").agg(
        *[
            agg(F.when(side, F.col("value"))).alias(f"{name}_{label}")
            for name, side in sides.items()
            for label, agg in (
                ("mean", F.avg), ("std", _deviation), ("min", F.min), ("max", F.max), ("count", F.count),
            )
        ]
    )
    steps = ecdf(real, synth, cols)

    def at(side: str, position: Column) -> Column:
        return F.min(F.when(F.col(f"cum_n_{side}") >= position, F.col("value")))

    medians = steps.groupBy("column_name").agg(
        *[
            (
                (
                    at(side, F.floor((F.col(f"all_n_{side}") + 1) / 2))
                    + at(side, F.floor((F.col(f"all_n_{side}") + 2) / 2))
                )
                / 2
            ).alias(f"{side}_median")
            for side in sides
        ]
    )

    def relative(label: str) -> Column:
        a, b = F.col(f"real_{label}"), F.col(f"synth_{label}")
        return F.when(a == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), F.abs(a)))

    return (
        moments.join(F.broadcast(medians), "column_name")
        .filter("real_count > 0 and synth_count > 0")
        .withColumn("relative_mean_difference", relative("mean"))
        .withColumn("relative_std_difference", relative("std"))
    )


def exact_quantiles(counts: DataFrame, group: str, order: str, measure: str, probs: list[float]) -> DataFrame:
    """Smallest value whose cumulative share reaches each probability, one array per group."""
    steps = running_totals(counts, group, order, [measure])
    targets = [F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col(f"all_{measure}"))) for p in probs]
    return steps.groupBy(group).agg(
        F.array(*[F.min(F.when(F.col(f"cum_{measure}") >= t, F.col(order))) for t in targets]).alias("quantiles"),
        F.max(f"all_{measure}").alias("n_values"),
    )


def medians(df: DataFrame, cols: list[str], room: float = 0.002, at_once: bool = False) -> DataFrame:
    """(column_name, median) of numeric columns: the mean of the two middle values, nulls left out.

    Approximate quantiles around the middle tell which values need counting; what lies below them is
    only counted. A column whose middle is not between them has all its values counted. With ``at_once`` Python tasks
    count between cuts, and the medians are known now.
    """
    if at_once:
        return _medians_at_once(df, cols)
    plain = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    near = plain.agg(*[F.percentile_approx(f"c{i}", [0.5 - room, 0.5 + room], 10_000).alias(f"c{i}") for i in range(len(cols))]).first()
    spans = {i: near[f"c{i}"] for i in range(len(cols)) if near[f"c{i}"]}
    if not spans:
        return _empty(df.sparkSession, "column_name string, median double")
    below = lambda c, x: F.count_if(F.col(c) < F.lit(x))
    row = plain.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in spans], *[below(f"c{i}", low).alias(f"b{i}") for i, (low, _) in spans.items()], *[F.count_if(F.col(f"c{i}") <= F.lit(high)).alias(f"t{i}") for i, (_, high) in spans.items()]).first()
    first = {i: (row[f"n{i}"] + 1) // 2 for i in spans}  # places of the two middle values, from 1
    second = {i: row[f"n{i}"] // 2 + 1 for i in spans}
    inside = {i: row[f"b{i}"] < first[i] and second[i] <= row[f"t{i}"] for i in spans}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(f"c{i}").between(*map(F.lit, spans[i])) if inside[i] else F.lit(True), F.col(f"c{i}")).alias("value")) for i in spans])
    counts = plain.select(F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("_v")).select(F.col("_v.i").cast("string").alias("i"), "_v.value").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = running_totals(counts, "i", "value", ["n"])
    at = lambda places: F.get(F.array(*[F.lit(places.get(i, 0) - (row[f"b{i}"] if inside.get(i) else 0)).cast("bigint") for i in range(len(cols))]), F.col("i").cast("int"))
    reach = lambda places: F.min(F.when(F.col("cum_n") >= at(places), F.col("value")))
    found = steps.groupBy("i").agg((0.5 * reach(first) + 0.5 * reach(second)).alias("median"))
    return found.select(F.get(F.array(*[F.lit(c) for c in cols]), F.col("i").cast("int")).alias("column_name"), "median")


def _medians_at_once(df: DataFrame, cols: list[str]) -> DataFrame:
    plain = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sizes, slices = plain.agg(*[F.count(c).alias(c) for c in plain.columns]).first(), Slices([plain])
    middle = [[(n + 1) // 2, n // 2 + 1] if n else [] for n in sizes]
    found = values_at(slices, [np.array([r for r in m if r <= c.sum()], dtype=np.int64) for m, c in zip(middle, slices.counts, strict=True)])
    whole = [(c, [*v, *[float("nan")] * (len(m) - len(v))]) for c, m, v in zip(cols, middle, found, strict=True) if m]  # NaN stands above all numbers
    return local_rows(df.sparkSession, [(c, 0.5 * v[0] + 0.5 * v[1]) for c, v in whole], "column_name string, median double")


# --- category columns ---------------------------------------------------------


def category_profile(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Category counts with the column totals beside them (one broadcast row per column)."""
    counts = value_counts(real, synth, cols, as_text=True).filter(F.col("n_real") + F.col("n_synth") >= 0)
    totals = counts.groupBy("column_name").agg(
        F.sum("n_real").alias("all_real"), F.sum("n_synth").alias("all_synth"), F.count(F.lit(1)).alias("categories")
    )
    return counts.join(F.broadcast(totals), "column_name")


def chi_square(real: DataFrame, synth: DataFrame, csv_semantics: bool = True) -> DataFrame:
    """Chi-square homogeneity statistic and degrees of freedom per category column.

    One degree of freedom gets the continuity correction. A column with one
    category, or with an empty side, has no test and is left out.
    """
    cols = text_columns(real, synth, csv_semantics)
    if not cols:
        return _empty(real.sparkSession, "column_name string, chi2_statistic double, degrees_of_freedom bigint")
    grand = F.col("all_real") + F.col("all_synth")
    row = F.col("n_real") + F.col("n_synth")

    def cell(seen: str, side: str) -> Column:
        expected = F.col(side).cast("double") * row / grand
        miss = F.abs(F.col(seen) - expected)
        miss = F.when(F.col("categories") == 2, miss - F.least(F.lit(0.5), miss)).otherwise(miss)
        return miss * miss / expected

    return (
        category_profile(real, synth, cols)
        .filter("categories > 1 and all_real > 0 and all_synth > 0")
        .groupBy("column_name")
        .agg(
            F.sum(cell("n_real", "all_real") + cell("n_synth", "all_synth")).alias("chi2_statistic"),
            (F.max("categories") - 1).alias("degrees_of_freedom"),
        )
    )


def chi_square_test(real: DataFrame, synth: DataFrame, csv_semantics: bool = True) -> DataFrame:
    tested = chi_square(real, synth, csv_semantics)
    return _verdict(tested.withColumn("p_value", chi2_pvalue(F.col("chi2_statistic"), F.col("degrees_of_freedom").cast("double"))))


def tvd(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Total variation distance per category column over the union of categories."""
    if not cols:
        return _empty(real.sparkSession, "column_name string, tvd double")
    share = lambda n, total: F.coalesce(F.try_divide(F.col(n), F.col(total)), F.lit(0.0))
    return (
        category_profile(real, synth, cols)
        .groupBy("column_name")
        .agg((F.sum(F.abs(share("n_real", "all_real") - share("n_synth", "all_synth"))) * 0.5).alias("tvd"))
    )


# --- audits -------------------------------------------------------------------


def audit_quality(real: DataFrame, synth: DataFrame, csv_semantics: bool = True, at_once: bool = False) -> DataFrame:
    """Distance per common column (TVD for text, KS otherwise) and the overall score 1 - mean.

    With ``at_once`` the KS distances are computed now, in Python tasks that move few values, instead of in the plan by a sort of all.
    """
    text = text_columns(real, synth, csv_semantics)
    other = [c for c in common_columns(real, synth) if c not in text]
    textual = (T.StringType, *TEMPORAL) if csv_semantics else (T.StringType,)
    mismatched = [c for c in other if isinstance(_type(synth, c), textual)]
    numeric = [c for c in other if c not in mismatched]
    parts = []
    if text:
        parts.append(tvd(real, synth, text).select("column_name", F.lit("TVD").alias("metric"), F.col("tvd").alias("score")))
    if numeric:
        parts.append(
            (_ks_largest if at_once else ks_statistic)(real, synth, numeric).select(
                "column_name", F.lit("KS-Stat").alias("metric"), F.col("statistic").alias("score")
            )
        )
    if mismatched:  # a number against text cannot be compared: full distance
        names = F.explode(F.array(*[F.lit(c) for c in mismatched])).alias("column_name")
        parts.append(real.sparkSession.range(1).select(names, F.lit("KS-Stat").alias("metric"), F.lit(1.0).alias("score")))
    if not parts:
        return _empty(real.sparkSession, "column_name string, metric string, score double, overall_score double")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    # one row per column, so this window is as small as the schema
    return rows.withColumn("overall_score", 1.0 - F.avg("score").over(Window.partitionBy(F.lit(1))))


def column_shapes(real: DataFrame, synth: DataFrame, csv_semantics: bool = True) -> DataFrame:
    """Similarity per column: 1 - KS or 1 - TVD."""
    return audit_quality(real, synth, csv_semantics).select(
        "column_name", "metric", (1.0 - F.col("score")).alias("shape_score")
    )


# --- correlation --------------------------------------------------------------


def _pair_sums(d: int):
    """Function of Pandas frames of ``d`` numeric columns: a row for each pair of columns."""

    def merged(one, two):
        """Pairwise numbers, means, squares and products about the means, and ranges of two disjoint sets of rows together."""
        n, m, q, c, low, high = one
        n2, m2, q2, c2, low2, high2 = two
        whole, step = np.maximum(n + n2, 1), m2 - m
        part = n * n2 / whole
        return n + n2, m + step * n2 / whole, q + q2 + step * step * part, c + c2 + step * step.T * part, np.minimum(low, low2), np.maximum(high, high2)

    def comoments(frame):
        """Those of one batch: matrices with a row for each column and a column for each other that has to be known beside it."""
        x = frame.to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(x)
        kept = known.astype(float)
        shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(kept.sum(axis=0), 1)
        z = np.where(known, x - shift, 0.0)
        n, s = kept.T @ kept, z.T @ kept
        m = s / np.maximum(n, 1)
        low, high = (np.repeat(r[:, None], len(r), axis=1) for r in (np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)))
        if not known.all():
            for j in range(x.shape[1]):  # only rows in which both are known
                both = known & known[:, [j]]
                low[:, j], high[:, j] = np.where(both, x, np.inf).min(axis=0), np.where(both, x, -np.inf).max(axis=0)
        return n, np.where(n > 0, m + shift[:, None], 0.0), (z * z).T @ kept - s * m, z.T @ z - s * m.T, low, high

    def sums(batches):
        whole = None
        for frame in batches:
            if len(frame):
                whole = comoments(frame) if whole is None else merged(whole, comoments(frame))
        if whole is not None:
            n, m, q, c, low, high = whole
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "m": m[i, j], "o": m[j, i], "q": q[i, j], "r": q[j, i], "c": c[i, j],
                                "low": low[i, j], "high": high[i, j], "low2": low[j, i], "high2": high[j, i]})

    return sums


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long matrix (col_a, col_b, corr) of pairwise-complete Pearson coefficients from one pass over the table; null where a side is constant.

    Each task adds up matrices of its Arrow batches and leaves a row for each pair. As aggregates
    of Spark, three for each pair, the pass is one method too long for Java to compile.
    """
    clean = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    d = len(cols)
    kinds = ", ".join(["i int, j int", *[f"{k} double" for k in ("n", "m", "o", "q", "r", "c", "low", "high", "low2", "high2")]])
    # a row for each task and pair
    parts = clean.mapInPandas(_pair_sums(d), kinds).groupBy("i", "j").agg(
        F.collect_list(F.struct("n", "m", "o", "q", "r", "c")).alias("parts"),
        ((F.min("low") < F.max("high")) & (F.min("low2") < F.max("high2"))).alias("vary"),
    )
    added = lambda of: F.aggregate("parts", F.lit(0.0), lambda s, p: s + of(p))
    mean = lambda k: F.try_divide(added(lambda p: p["n"] * p[k]), added(lambda p: p["n"]))
    about = parts.withColumn("a", mean("m")).withColumn("b", mean("o"))
    a, b = F.col("a"), F.col("b")
    spread = lambda q, m, at: F.sqrt(added(lambda p: p[q] + p["n"] * (p[m] - at) * (p[m] - at)))
    product = added(lambda p: p["c"] + p["n"] * (p["m"] - a) * (p["o"] - b))
    coefficient = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(product, spread("q", "m", a) * spread("r", "o", b)))
    found = about.select("i", "j", F.when(F.col("vary"), coefficient).alias("corr"))
    names = F.array(*[F.lit(c) for c in cols])
    name = lambda k: F.get(names, F.col(k))
    pair = lambda x, y: F.struct(name(x).alias("col_a"), name(y).alias("col_b"))
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array(pair("i", "j"))).otherwise(F.array(pair("i", "j"), pair("j", "i"))))
    cells = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i")).select("i", F.explode(F.sequence(F.col("i"), F.lit(d - 1))).alias("j"))
    # a table without rows has its pairs too
    every = cells.select(F.col("i").cast("int"), F.col("j").cast("int")).join(F.broadcast(found), ["i", "j"], "left")
    return every.select(sides.alias("_of"), "corr").select("_of.col_a", "_of.col_b", "corr")


def correlation_difference(real: DataFrame, synth: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Both coefficients and their absolute difference for every pair of columns."""
    cols = cols or numeric_columns(real, synth)
    left = correlation_matrix(real, cols).withColumnRenamed("corr", "real_corr")
    right = correlation_matrix(synth, cols).withColumnRenamed("corr", "synth_corr")
    return left.join(F.broadcast(right), ["col_a", "col_b"]).withColumn("diff", F.abs(F.col("real_corr") - F.col("synth_corr")))


def correlation_preservation(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Largest and mean coefficient difference with its label. Needs two numeric columns."""
    cols = numeric_columns(real, synth)
    if len(cols) < 2:
        raise ValueError("a correlation needs two numeric columns on both sides")
    per_column = correlation_difference(real, synth, cols).groupBy("col_b").agg(
        F.max("diff").alias("worst"), F.avg("diff").alias("typical")
    )
    worst = F.col("max_correlation_difference")
    return per_column.agg(
        F.max("worst").alias("max_correlation_difference"), F.avg("typical").alias("mean_correlation_difference")
    ).withColumn(
        "correlation_preservation_quality",
        F.when(worst < 0.1, "Excellent").when(worst < 0.2, "Good").when(worst < 0.3, "Fair").otherwise("Poor"),
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns with average ranks for ties."""
    whole = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    joint = settled(whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))

    def ranks(name: str) -> DataFrame:
        counts = joint.groupBy(F.lit(name).alias("axis"), F.col(name)).agg(
            F.sum("w").alias("n")
        )
        placed = running_totals(counts, "axis", name, ["n"])
        middle = (F.col("all_n") + 1) / 2
        return placed.select(
            name, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2 - middle).alias(f"r_{name}")
        )

    on_b = lookup_by_key(lookup_by_key(joint, ranks("a"), ["a"]), ranks("b"), ["b"])
    w, ra, rb = F.col("w"), F.col("r_a"), F.col("r_b")
    return on_b.agg(
        F.try_divide(F.sum(w * ra * rb), F.sqrt(F.sum(w * ra * ra)) * F.sqrt(F.sum(w * rb * rb))).alias("spearman"),
        F.sum("w").alias("n_rows"),
    )


def pair_trends(real: DataFrame, synth: DataFrame, csv_semantics: bool = True) -> DataFrame:
    """Similarity per column pair: correlation for numbers, contingency shares for text."""
    numeric = numeric_columns(real, synth)
    text = text_columns(real, synth, csv_semantics)
    parts = []
    if len(numeric) > 1:
        parts.append(
            correlation_difference(real, synth, numeric)
            .filter(F.col("col_a") < F.col("col_b"))
            .select("col_a", "col_b", (1.0 - F.col("diff") / 2).alias("pair_score"))
        )
    if len(text) > 1:
        pairs = [tuple(sorted(p)) for p in combinations(text, 2)]

        def side(df: DataFrame, is_real: int) -> DataFrame:
            cells = F.array(
                *[
                    F.struct(
                        F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                        F.col(a).cast("string").alias("val_a"), F.col(b).cast("string").alias("val_b"),
                    )
                    for a, b in pairs
                ]
            )
            return df.select(F.inline(cells)).dropna().withColumn("in_real", F.lit(is_real))

        joint = (
            side(real, 1).unionByName(side(synth, 0))
            .groupBy("col_a", "col_b", "val_a", "val_b")
            .agg(F.sum("in_real").alias("n_real"), F.sum(1 - F.col("in_real")).alias("n_synth"))
            .filter(F.col("n_real") + F.col("n_synth") >= 0)
        )
        totals = joint.groupBy("col_a", "col_b").agg(F.sum("n_real").alias("all_real"), F.sum("n_synth").alias("all_synth"))
        share = lambda n, t: F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0))
        parts.append(
            joint.join(F.broadcast(totals), ["col_a", "col_b"])
            .groupBy("col_a", "col_b")
            .agg((1.0 - F.sum(F.abs(share("n_real", "all_real") - share("n_synth", "all_synth"))) * 0.5).alias("pair_score"))
        )
    if not parts:
        return _empty(real.sparkSession, "col_a string, col_b string, pair_score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quality_report(real: dict[str, DataFrame], synth: dict[str, DataFrame]) -> DataFrame:
    """Shape, pair and overall score per table common to both sets."""
    out = None
    for name in [t for t in real if t in synth]:
        scores = column_shapes(real[name], synth[name]).select(
            F.lit("shape").alias("kind"), F.col("shape_score").alias("score")
        ).unionByName(
            pair_trends(real[name], synth[name]).select(F.lit("pair").alias("kind"), F.col("pair_score").alias("score"))
        )
        of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("score")))
        row = scores.agg(of("shape").alias("shape_score"), of("pair").alias("pair_score")).select(
            F.lit(name).alias("table_name"),
            "shape_score",
            "pair_score",
            ((F.col("shape_score") + F.coalesce("pair_score", "shape_score")) / 2).alias("overall_score"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def quality_overall(report: DataFrame) -> DataFrame:
    """Mean scores over the tables of ``quality_report``."""
    return report.agg(
        F.count(F.lit(1)).alias("tables"),
        *[F.avg(c).alias(c) for c in ("shape_score", "pair_score", "overall_score")],
    )


# --- scores -------------------------------------------------------------------


def quality_label(score: Column) -> Column:
    # fixed values: score thresholds and their wording
    return (
        F.when(score >= 0.9, "Excellent - Synthetic data closely matches real data")
        .when(score >= 0.8, "Very Good - Minor differences in some distributions")
        .when(score >= 0.7, "Good - Acceptable quality with some notable differences")
        .when(score >= 0.6, "Fair - Significant differences that may impact use cases")
        .when(score >= 0.5, "Poor - Major differences requiring attention")
        .when(score.isNotNull(), "Very Poor - Synthetic data significantly differs from real data")
        .otherwise("Unable to calculate quality score")
    )


def _tests(real: DataFrame, synth: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """KS, chi-square and correlation results, each absent where no column qualifies."""
    numeric = numeric_columns(real, synth)
    return (
        ks_test(real, synth) if numeric else None,
        chi_square_test(real, synth) if text_columns(real, synth) else None,
        correlation_preservation(real, synth) if len(numeric) > 1 else None,
    )


def quality_score(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Mean of the KS pass rate, chi-square pass rate and correlation score that exist."""
    return _score(real.sparkSession, *_tests(real, synth))


def _score(spark, ks: DataFrame | None, chi: DataFrame | None, corr: DataFrame | None) -> DataFrame:
    passed = F.avg(F.col("similar_distribution").cast("double"))
    parts = []
    if ks is not None:
        parts.append(ks.agg(passed.alias("score")).select(F.lit("ks").alias("part"), "score"))
    if chi is not None:
        parts.append(chi.agg(passed.alias("score")).select(F.lit("chi2").alias("part"), "score"))
    if corr is not None:
        kept = F.greatest(F.lit(0.0), 1.0 - F.col("max_correlation_difference"))
        # undefined throughout: the score component is 0
        parts.append(
            corr.select(
                F.lit("corr").alias("part"),
                F.when(F.col("max_correlation_difference").isNull(), 0.0).otherwise(kept).alias("score"),
            )
        )
    scores = parts[0] if parts else _empty(spark, "part string, score double")
    for more in parts[1:]:
        scores = scores.unionByName(more)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("score")))
    return scores.agg(
        of("ks").alias("ks_test_pass_rate"),
        of("chi2").alias("chi2_test_pass_rate"),
        of("corr").alias("correlation_preservation_score"),
        F.avg("score").alias("overall_score"),
    ).withColumn("quality_interpretation", quality_label(F.col("overall_score")))


def row_ratio(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Row counts of both sides and synthetic / real (0 for an empty real side)."""
    flags = real.select(F.lit(1).alias("r")).unionByName(synth.select(F.lit(0).alias("r")))
    counted = flags.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("real_data_rows"),
        F.coalesce(F.sum(1 - F.col("r")), F.lit(0)).alias("synthetic_data_rows"),
    )
    return counted.withColumn(
        "generation_ratio",
        F.coalesce(F.try_divide(F.col("synthetic_data_rows"), F.col("real_data_rows")), F.lit(0.0)),
    )


def evaluate_table(name: str, real: DataFrame, synth: DataFrame) -> DataFrame:
    """Every metric of one table as (table_name, column_name, metric, value)."""

    def melt(df: DataFrame, metrics: list[str], column: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select(F.lit(name).alias("table_name"), column.alias("column_name"), F.inline(cells))

    whole = F.lit("*")
    # one row per column each: kept once, read by the report and by the score
    ks, chi, corr = (settled(t) if t is not None else None for t in _tests(real, synth))
    rows = melt(row_ratio(real, synth), ["real_data_rows", "synthetic_data_rows", "generation_ratio"], whole)
    if ks is not None:
        named = ks.withColumnsRenamed({"statistic": "ks_statistic", "p_value": "ks_p_value"})
        rows = rows.unionByName(melt(named, ["ks_statistic", "ks_p_value"], F.col("column_name")))
        stats = settled(basic_statistics(real, synth))
        rows = rows.unionByName(melt(stats, [c for c in stats.columns if c != "column_name"], F.col("column_name")))
    if chi is not None:
        named = chi.withColumnRenamed("p_value", "chi2_p_value")
        rows = rows.unionByName(melt(named, ["chi2_statistic", "degrees_of_freedom", "chi2_p_value"], F.col("column_name")))
    if corr is not None:
        rows = rows.unionByName(melt(corr, ["max_correlation_difference", "mean_correlation_difference"], whole))
    return rows.unionByName(melt(_score(real.sparkSession, ks, chi, corr), ["overall_score"], whole))


def evaluate_tables(real: dict[str, DataFrame], synth: dict[str, DataFrame]) -> DataFrame:
    """Metrics of every table present in both sets."""
    shared = [t for t in real if t in synth]
    if not shared:
        raise ValueError("the two sets share no table")
    out = evaluate_table(shared[0], real[shared[0]], synth[shared[0]])
    for name in shared[1:]:
        out = out.unionByName(evaluate_table(name, real[name], synth[name]))
    return out


def evaluate_named(name: str, real: dict[str, DataFrame], synth: dict[str, DataFrame]) -> DataFrame:
    """Metrics of one table of the two sets."""
    if name not in real or name not in synth:
        raise ValueError(f"{name} is missing on one side")
    return evaluate_table(name, real[name], synth[name])


def overall_summary(evaluation: DataFrame) -> DataFrame:
    """Totals and the mean table score over the rows of ``evaluate_tables``."""
    of = lambda metric: F.when(F.col("metric") == metric, F.col("value"))
    summed = evaluation.filter(F.col("column_name") == "*").agg(
        F.sum(of("real_data_rows")).cast("bigint").alias("total_real_rows"),
        F.sum(of("synthetic_data_rows")).cast("bigint").alias("total_synthetic_rows"),
        F.count_if(F.col("metric") == "real_data_rows").alias("tables_evaluated"),
        F.avg(of("overall_score")).alias("average_quality_score"),
    )
    return summed.withColumn(
        "overall_generation_ratio",
        F.coalesce(F.try_divide(F.col("total_synthetic_rows"), F.col("total_real_rows")), F.lit(0.0)),
    ).withColumn("quality_interpretation", quality_label(F.col("average_quality_score")))


# --- distribution views -------------------------------------------------------


def histogram_pair(real: DataFrame, synth: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Counts of both sides in equal-width bins over the shared range of each column."""
    counts = value_counts(real, synth, cols, as_text=False).filter(F.col("n_real") + F.col("n_synth") >= 0)
    spans = counts.groupBy("column_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.coalesce(F.floor(F.try_divide((F.col("value") - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(0))
    return (
        counts.join(F.broadcast(spans), "column_name")
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("bigint"))
        .groupBy("column_name", "bin")
        .agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth"))
    )


def cdf_pair(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Distribution functions of both sides at every distinct value."""
    return ecdf(real, synth, cols).select(
        "column_name",
        "value",
        F.try_divide(F.col("cum_n_real"), F.col("all_n_real")).alias("cdf_real"),
        F.try_divide(F.col("cum_n_synth"), F.col("all_n_synth")).alias("cdf_synth"),
    )


# --- integrity ----------------------------------------------------------------


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows and distinct keys whose parent is missing; null keys do not count."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lost = keys.join(parent.select(F.col(pk).alias("k")).distinct(), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))


def pk_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Number of duplicated keys and of rows carrying them."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Repeated values, and the rows that carry them, of every column declared UNIQUE; nulls never collide."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("value").alias("n"))
    return counts.groupBy("column_name").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_values"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows")
    )


def not_null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count per column declared NOT NULL, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counted.unpivot([], cols, "column_name", "violations")
