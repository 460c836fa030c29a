"""Normal distribution function as a column expression, and the constants of its inverse.

Spark has neither; both are published rational approximations (Abramowitz and
Stegun 26.2.17, error below 7.5e-8; Acklam's inverse, relative error 1.2e-9).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of the two approximations
CDF = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
INV_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
INV_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
INV_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
INV_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def cdf(z: Column) -> Column:
    t = F.lit(1.0) / (F.abs(z) * 0.2316419 + 1.0)
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * _horner(CDF[::-1], t)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def cdf_of():
    """``cdf`` as a function of an array, which goes to the tasks whole."""

    def cdf(z: np.ndarray) -> np.ndarray:
        t = 1.0 / (np.abs(z) * 0.2316419 + 1.0)
        tail = np.exp(-z * z / 2) * 0.3989422804014327 * t * np.polyval(CDF[::-1], t)
        return np.where(z >= 0, 1.0 - tail, tail)

    return cdf
