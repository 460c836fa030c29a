"""Draws from priors: exact laws by quantiles and probabilities, extreme parameters, refusals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mockloom.functions import priors as draw
from mockloom.operators import generate

N = 20_000
COLUMNS = "column_name string, dist_type string, p1 double, p2 double, p3 double, p4 double, weights array<double>"
INF = float("inf")


def drawn(spark, *priors, n=N):
    ids = spark.range(n).withColumnRenamed("id", "row").repartition(8)
    rows = [(str(i), *p, *[None] * (6 - len(p))) for i, p in enumerate(priors)]
    found = generate.sample_priors(ids, "row", spark.createDataFrame(rows, COLUMNS)).toPandas()
    return [np.sort(found[found.column_name == str(i)]["value"].to_numpy()) for i in range(len(priors))]


def ks(values, reference):
    """Kolmogorov-Smirnov distance to a sorted reference sample."""
    both = np.concatenate([values, reference])
    return np.abs(np.searchsorted(values, both, "right") / len(values) - np.searchsorted(reference, both, "right") / len(reference)).max()


def test_laws(spark):
    rng = np.random.default_rng(1)
    size = 400_000
    cut = rng.normal(size=4_000_000)
    cases = [
        (("Gamma", 0.3, 2.0), rng.gamma(0.3, 2.0, size)), (("gamma", 7.5, 0.5), rng.gamma(7.5, 0.5, size)), (("gamma", 1.0, 1.0), rng.gamma(1.0, 1.0, size)),
        (("Beta", 0.5, 0.5), rng.beta(0.5, 0.5, size)), (("beta", 2.0, 5.0), rng.beta(2.0, 5.0, size)),
        (("Poisson", 0.2), rng.poisson(0.2, size)), (("poisson", 9.9), rng.poisson(9.9, size)), (("poisson", 10.0), rng.poisson(10.0, size)),
        (("poisson", 1234.5), rng.poisson(1234.5, size)),
        (("Truncated Normal", 5.0, 2.0, 4.0, 11.0), 5 + 2 * cut[(cut >= -0.5) & (cut <= 3.0)]),
        (("truncated normal", 0.0, 1.0, 1.0, None), cut[cut >= 1.0]), (("truncated normal", 0.0, 1.0, None, -1.0), cut[cut <= -1.0]),
        (("truncated normal", 0.0, 1.0, 0.1, 0.3), cut[(cut >= 0.1) & (cut <= 0.3)]), (("truncated normal", 0.0, 1.0, -0.2, 0.3), cut[(cut >= -0.2) & (cut <= 0.3)]),
        (("truncated normal", 3.0, 2.0), 3 + 2 * cut),
    ]
    for (prior, reference), values in zip(cases, drawn(spark, *[c[0] for c in cases]), strict=True):
        assert len(values) == N and ks(values, np.sort(reference)) < 0.0155, prior  # 1.95 / sqrt(N) holds once in 1,000


def test_shares(spark):
    shares = [0.0, 3.0, 0.0, 1.0, 6.0, 0.0]
    values, alone = drawn(spark, ("Categorical", None, None, None, None, shares), ("categorical", None, None, None, None, [0.0, 0.5]))
    assert np.abs(np.bincount(values.astype(int), minlength=6) / N - np.array(shares) / 10).max() < 0.015
    assert set(np.unique(values)) == {1.0, 3.0, 4.0} and set(alone) == {1.0}


def test_far_tails_and_large_parameters(spark):
    tail, left, huge, many, sharp = drawn(spark, ("truncated normal", 0.0, 1.0, 30.0, None), ("truncated normal", 100.0, 1.0, 0.0, 1.0),
                                          ("gamma", 1e8, 1.0), ("poisson", 1e8), ("truncated normal", 0.0, 1.0, 12.0, 12.001), n=4000)
    assert tail.min() >= 30 and abs(tail.mean() - (30 + 1 / 30)) < 0.003  # nearly exponential of rate 30
    assert left.max() <= 1 and left.min() >= 0 and left.mean() > 0.98
    assert abs(huge.mean() / 1e8 - 1) < 1e-5 and abs(huge.std() / 1e4 - 1) < 0.05
    assert abs(many.mean() / 1e8 - 1) < 1e-5 and abs(many.std() / 1e4 - 1) < 0.05 and (many == np.floor(many)).all()
    assert sharp.min() >= 12 and sharp.max() <= 12.001


def test_log_gamma(spark):
    at = [1.0, 1.5, 2.0, 3.0, 10.0, 123.0, 1e6]
    got = spark.createDataFrame([(x,) for x in at], "x double").select("x", draw.log_gamma(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - math.lgamma(r["x"])) <= 1e-10 * max(1, abs(r["y"])) for r in got)


@pytest.mark.parametrize("prior", [
    ("gamma", 0.0, 1.0), ("gamma", 1.0, None), ("beta", -1.0, 1.0), ("poisson", INF), ("poisson",), ("truncated normal", 0.0, 1.0, 2.0, 2.0),
    ("truncated normal", 0.0, 0.0), ("categorical",), ("categorical", None, None, None, None, []), ("categorical", None, None, None, None, [0.0]),
    ("categorical", None, None, None, None, [1.0, -1.0]), ("categorical", None, None, None, None, [1.0, None]),
])
def test_parameters_out_of_range(spark, prior):
    with pytest.raises(Exception, match="out of range"):
        drawn(spark, prior, n=1)


def test_partitions_do_not_matter(spark):
    priors = spark.createDataFrame([("a", "gamma", 2.0, 1.0), ("b", "poisson", 50.0, None)], "column_name string, dist_type string, p1 double, p2 double")
    runs = [sorted(map(tuple, generate.sample_priors(spark.range(50).toDF("row").repartition(k), "row", priors).collect())) for k in (1, 5)]
    assert runs[0] == runs[1]
