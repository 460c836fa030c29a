"""Sketches of growing tables against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mockloom.operators import fidelity, sketches


def batches(spark, rng, shift, count=3, n=40_000):
    return [spark.createDataFrame([(float(x), int(k), None) for x, k in zip(rng.normal(shift + i, 2, n), rng.integers(0, 5 + i, n))], "x double, k int, e double").repartition(4)
            for i in range(count)]


def test_sketches_of_batches_stand_for_all_rows(spark, tmp_path):
    rng, cols = np.random.default_rng(3), ["x", "k", "e"]
    stores, whole = [], []
    for name, shift in (("real", 0.0), ("synth", 0.4)):
        days = batches(spark, rng, shift)
        for i, day in enumerate(days):
            sketches.append_sketch(day, cols, f"{tmp_path}/{name}", i)
        sketches.append_sketch(days[1], cols, f"{tmp_path}/{name}", 1)  # delivered again
        stores.append(sketches.merged(spark, f"{tmp_path}/{name}"))
        whole.append(days[0].union(days[1]).union(days[2]))
    exact = {r["column_name"]: r["statistic"] for r in fidelity.ks_statistic(*[w.select("x", "k") for w in whole], ["x", "k"]).collect()}
    got = {r["column_name"]: r["statistic"] for r in sketches.sketched_ks(*stores).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[c] - exact[c]) <= sketches.ks_error() for c in exact), (got, exact)
    figures = {r["column_name"]: r for r in sketches.sketched_statistics(stores[0]).collect()}
    want = whole[0].agg(F.avg("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    r = figures["x"]
    assert (r["n"], r["nulls"]) == (120_000, 0) and np.allclose([r["mean"], r["deviation"], r["low"], r["high"]], list(want))
    below = whole[0].filter(F.col("x") <= r["median"]).count() / 120_000
    assert abs(below - 0.5) <= sketches.RANK_ERROR
    assert (figures["e"]["n"], figures["e"]["nulls"], figures["e"]["median"], figures["e"]["mean"]) == (0, 120_000, None, None)


def test_small_and_constant_columns(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, 7.0), (float("nan"), 7.0), (None, 7.0), (3.0, 7.0)], "a double, b double")
    sketches.append_sketch(frame, ["a", "b"], f"{tmp_path}/s", 0)
    sketches.append_sketch(frame.limit(0), ["a", "b"], f"{tmp_path}/s", 1)
    a, b = sketches.sketched_statistics(sketches.merged(spark, f"{tmp_path}/s")).orderBy("column_name").collect()
    assert (a["n"], a["nulls"], a["mean"], a["low"], a["high"]) == (2, 2, 2.0, 1.0, 3.0) and a["deviation"] == pytest.approx(2**0.5)
    assert (b["deviation"], b["median"]) == (0.0, 7.0)
    same = sketches.merged(spark, f"{tmp_path}/s")
    assert {r["statistic"] for r in sketches.sketched_ks(same, same).collect()} == {0.0}
