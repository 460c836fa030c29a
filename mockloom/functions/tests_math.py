"""Tail probabilities of the two-sample tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of a Kolmogorov-Smirnov distance."""
    lam = statistic * F.sqrt((n.cast("double") * m) / (n.cast("double") + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    # the alternating series does not settle for tiny arguments, where p is 1
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chi2_pvalue(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, evaluated on one row per tested column.

    Spark has no incomplete gamma function. Everything the workers need is
    nested here, so the function travels by value.
    """

    def upper_gamma(a, x):
        import math

        if x <= 0:
            return 1.0
        scale = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1.0 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= x / k
                total += term
            return max(0.0, 1.0 - total * scale)
        tiny = 1e-300
        b = x + 1 - a
        c, d = 1 / tiny, 1 / b
        h, i, step = d, 0, 0.0
        while abs(step - 1) > 1e-15 and i < 1_000_000:
            i += 1
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or tiny)
            c = b + an / c or tiny
            step = d * c
            h *= step
        return h * scale

    def tails(stats: pd.Series, dofs: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series([upper_gamma(d / 2.0, s / 2.0) for s, d in zip(stats, dofs)], dtype="float64")

    return F.pandas_udf(tails, "double")(statistic, dof)
