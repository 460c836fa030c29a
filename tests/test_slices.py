"""Exact ranks from counts between cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mockloom.operators import copula, fidelity, slices

SCHEMA = "a double, b int, c double, e double"


@pytest.fixture
def few(monkeypatch):
    for name, size in (("CUTS", 16), ("SAMPLED", 4), ("ROWS", 100), ("TOGETHER", 200)):
        monkeypatch.setattr(slices, name, size)


def rows(seed, n, shift=0.0):
    """Numbers, few values, one hot value and null, nothing."""
    r = np.random.default_rng(seed)
    return [(float(x + shift) if x > -2 else None if x > -2.5 else float("nan"), int(k), float(h) if h > 0.7 else 0.5, None) for x, k, h in zip(r.normal(size=n), r.integers(0, 7, n), r.random(n))]


def gap(real, synth):
    x, y = (np.sort([v for v in side if v is not None and v == v]) for side in (real, synth))
    both = np.concatenate([x, y])
    return np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max()


@pytest.mark.parametrize("shift", [0.0, 0.05, 3.0])
def test_audit_by_slices_is_exact(spark, few, shift):
    real, synth = rows(1, 3000), rows(2, 2000, shift)
    frames = [spark.createDataFrame(side, SCHEMA).repartition(3) for side in (real, synth)]
    found = {r["column_name"]: r["score"] for r in fidelity.audit_quality(*frames, at_once=True).collect()}
    assert found == pytest.approx({c: gap([r[i] for r in real], [r[i] for r in synth]) for i, c in enumerate("abc")}, abs=1e-15)
    assert found == pytest.approx({r["column_name"]: r["statistic"] for r in fidelity.ks_statistic(*frames, ["a", "b", "c", "e"]).collect()}, abs=1e-15)


def test_audit_with_an_empty_side(spark, few):
    frame = spark.createDataFrame(rows(1, 50), SCHEMA)
    found = fidelity.audit_quality(frame, frame.limit(0), at_once=True).collect()
    assert {(r["column_name"], r["score"]) for r in found} == {("a", None), ("b", None), ("c", None)}


def test_marginals_by_slices_are_exact(spark, few):
    real = rows(3, 2500)
    found = {r["column_name"]: r for r in copula.marginals(spark.createDataFrame(real, SCHEMA).repartition(3), ["a", "b", "c", "e"]).collect()}
    assert set(found) == set("abc")
    for i, c in enumerate("abc"):
        x = np.sort([r[i] for r in real if r[i] is not None and r[i] == r[i]])
        assert found[c]["quantiles"] == [float(x[max(1, -(-k * len(x) // 32)) - 1]) for k in range(33)] and found[c]["n_values"] == len(x)


def test_audit_moves_few_values(spark):
    """Only values between the cuts where the gap may be largest are dealt out."""
    sides = [spark.range(60_000).select((F.rand(seed) + F.lit(shift)).alias("x")) for seed, shift in ((1, 0.0), (2, 0.1))]
    both = slices.Slices(sides)
    moved = []
    within = both.within
    both.within = lambda wanted, *a: moved.append(sum(int(c[:, w].sum()) for w, c in zip(wanted, both.counts))) or within(wanted, *a)
    (found, n, m), = slices.largest_gaps(both)
    assert (n, m) == (60_000, 60_000) and found == pytest.approx(0.1, abs=0.01)
    assert sum(moved) < 20_000


def test_medians_at_once(spark, few):
    real = rows(4, 1501) + [(float("nan"), 1, float("inf"), None)] * 3
    frame = spark.createDataFrame(real, SCHEMA).repartition(3)
    found = {r["column_name"]: r["median"] for r in fidelity.medians(frame, ["a", "b", "c", "e"], at_once=True).collect()}
    assert found == {r["column_name"]: r["median"] for r in fidelity.medians(frame, ["a", "b", "c", "e"]).collect()} and set(found) == set("abc")
    assert fidelity.medians(frame.limit(0), ["a"], at_once=True).count() == 0
