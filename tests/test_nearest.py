"""Closest records over mixed columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mockloom.operators import nearest
from mockloom.operators.scan import settled

SCHEMA = "a double, kind string, b int, flag boolean"


def people(seed, n):
    r = random.Random(seed)
    pick = lambda v: None if r.random() < 0.15 else v
    return [(pick(r.gauss(0, 3)), pick(r.choice("xyzuvw") * r.randint(1, 3)), pick(r.randint(0, 40)), pick(r.random() < 0.3)) for _ in range(n)]


def brute(real, synth):
    spans = []
    for k in range(4):
        known = [row[k] for row in real + synth if row[k] is not None]
        spans.append((min(known), max(known)) if k in (0, 2) else None)

    def gap(x, y, span):
        if x is None or y is None:
            return 0.0 if x is y else 1.0
        if span is None:
            return float(x != y)
        return abs(x - y) / (span[1] - span[0])

    return sorted(min(math.sqrt(sum(gap(x, y, s) ** 2 for x, y, s in zip(p, q, spans))) for q in real) for p in synth)


def distances(df):
    return sorted(r["distance"] for r in df.collect() for _ in range(r["weight"]))


@pytest.mark.parametrize("n", [1, 40, 700])
def test_exact_search_over_numbers_texts_and_nulls(spark, n):
    real, synth = people(n, n), people(n + 1, 150) + people(n, 3)
    got = nearest.closest(spark.createDataFrame(real, SCHEMA), spark.createDataFrame(synth, SCHEMA), ["a", "kind", "b", "flag"], nulls=True)
    assert distances(got) == pytest.approx(brute(real, synth), abs=1e-9)


def test_points_meet_blocks_in_bounded_groups(spark, monkeypatch):
    """Many blocks, several tasks for one block, points of one null set apart and others not."""
    for name, size in (("BLOCK", 48), ("LEAF", 8), ("ASKED", 20), ("PATTERNS", 1)):
        monkeypatch.setattr(nearest, name, size)
    real, synth = people(3, 500), people(4, 200)
    got = nearest.closest(spark.createDataFrame(real, SCHEMA), spark.createDataFrame(synth, SCHEMA), ["a", "kind", "b", "flag"], nulls=True)
    assert distances(got) == pytest.approx(brute(real, synth), abs=1e-9)


def shuffled(spark):
    """Bytes of the shuffles that lie on disk, by file."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_shuffles_of_the_steps_are_gone_before_the_result_is_read(spark):
    sides = [spark.range(20_000).select(F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"), F.expr("array('u', 'v', null)[id % 3]").alias("kind")) for seed in (1, 5)]
    before = shuffled(spark)
    search = nearest.closest(*sides, ["a", "b", "kind"], nulls=True)
    assert sum(n for name, n in shuffled(spark).items() if name not in before) < 100_000
    assert search.count() == 20_000


def test_texts_that_no_real_row_has(spark, monkeypatch):
    """Many blocks, texts and nulls of one side only, points that come often."""
    for name, size in (("BLOCK", 48), ("LEAF", 8), ("ASKED", 20)):
        monkeypatch.setattr(nearest, name, size)
    real, synth = [r for r in people(8, 600) if r[1] is not None and "x" not in r[1]], people(9, 200) * 3
    search = nearest.closest(*[spark.createDataFrame(rows, SCHEMA) for rows in (real, synth)], ["a", "kind", "b", "flag"], nulls=True)
    assert distances(search) == pytest.approx(brute(real, synth), abs=1e-9)
    assert search.count() == search.select("x0", "x1", "x2", "x3").distinct().count()


def test_blocks_cut_by_halves_are_asked_by_few_points(spark, monkeypatch):
    """Points that have to ask elsewhere are those at the edges of blocks, not most of them."""
    monkeypatch.setattr(nearest, "BLOCK", 500)
    rng = np.random.default_rng(2)
    rows = [[(float(a), float(b), "uvw"[k]) for a, b, k in zip(rng.random(6000), rng.random(6000), rng.integers(0, 3, 6000))] for _ in range(2)]
    frames = [spark.createDataFrame(r, "a double, b double, kind string") for r in rows]
    kept = []
    monkeypatch.setattr(nearest, "settled", lambda *a: kept.append(settled(*a)) or kept[-1])
    nearest.closest(*frames, ["a", "b", "kind"], nulls=True)
    asked = sum(r["n"] for near in kept if "open" in near.columns for r in near.where("open").collect())
    assert 0 < asked < 2400


def test_projected_search_finds_most_and_never_less(spark):
    real, synth = people(5, 3000), people(6, 1500)
    frames = spark.createDataFrame(real, SCHEMA).repartition(5), spark.createDataFrame(synth, SCHEMA)
    columns = ["a", "kind", "b", "flag"]
    xs = [f"x{i}" for i in range(4)]
    exact = nearest.closest(*frames, columns, nulls=True).withColumnRenamed("distance", "exact").drop("weight")
    both = nearest.closest_projected(*frames, columns).join(exact, xs)
    rows, points, recall, low = both.agg(
        F.sum("weight"), F.count(F.lit(1)), F.avg((F.col("distance") <= F.col("exact") + 1e-9).cast("double")), F.count_if(F.col("distance") < F.col("exact") - 1e-9)).first()
    assert rows == 1500 and points == exact.count() and recall >= 0.9 and low == 0


def test_turns_leave_no_sorts_on_disk(spark):
    sides = [spark.range(10_000).select(F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"), F.expr("array('u', 'v', null)[id % 3]").alias("kind")) for seed in (1, 5)]
    before = shuffled(spark)
    search = nearest.closest_projected(*sides, ["a", "b", "kind"])
    assert search.count() == 10_000
    assert sum(n for name, n in shuffled(spark).items() if name not in before) < 100_000


def test_projected_search_in_many_tasks(spark, monkeypatch):
    """Points that come often, blocks smaller than the sample's, columns without numbers."""
    for name, size in (("BLOCK", 32), ("BESIDE", 300), ("ALONE", 300)):
        monkeypatch.setattr(nearest, name, size)
    real, synth = people(5, 1000) * 2, people(6, 400) * 3
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (real, synth)]
    for columns in (["a", "kind", "b", "flag"], ["kind", "flag"]):
        xs = [f"x{i}" for i in range(len(columns))]
        exact = nearest.closest(*frames, columns, nulls=True).select(*xs, F.col("distance").alias("exact"))
        both = nearest.closest_projected(*frames, columns).join(exact, xs)
        rows, points, recall, low = both.agg(
            F.sum("weight"), F.count(F.lit(1)), F.avg((F.col("distance") <= F.col("exact") + 1e-9).cast("double")), F.count_if(F.col("distance") < F.col("exact") - 1e-9)).first()
        assert rows == 1200 and points == exact.count() and recall >= 0.8 and low == 0


def test_nothing_to_be_near(spark):
    some = spark.createDataFrame(people(1, 5), SCHEMA)
    for search in (nearest.closest, nearest.closest_projected):
        assert search(some.limit(0), some, ["a", "kind"], nulls=True).where("distance is not null").count() == 0
        assert search(some, some.limit(0), ["a", "kind"], nulls=True).count() == 0


# --- membership inference -------------------------------------------------------------------------


def attack_by_pairs(spark, train, holdout, synth):
    """AUC and DeLong's error by comparing every member with every held-out row; columns: a number, a text."""
    top = [x for rows_ in (train, holdout, synth) for x, _ in rows_ if x is not None]
    low, high = min(top), max(top)

    def apart(a, b):
        x = 0.0 if a[0] is None and b[0] is None else 1.0 if a[0] is None or b[0] is None else abs(a[0] - b[0]) / (high - low)
        return x * x + (a[1] != b[1])

    near = lambda r: round(min(apart(r, s) for s in synth) ** 0.5, 9)
    m, o = np.array([near(r) for r in train]), np.array([near(r) for r in holdout])
    wins = (m[:, None] < o[None, :]) + 0.5 * (m[:, None] == o[None, :])
    error = (wins.mean(axis=1).var(ddof=1) / len(m) + wins.mean(axis=0).var(ddof=1) / len(o)) ** 0.5
    gap = max((m <= d).mean() - (o <= d).mean() for d in np.concatenate([m, o]))
    return wins.mean(), error, gap


def test_membership_attack(spark):
    rng = np.random.default_rng(5)
    schema = "x double, t string"
    rows_of = lambda n: [(None if rng.random() < 0.05 else float(round(rng.normal(), 2)), "abc"[rng.integers(3)] if rng.random() < 0.9 else None) for _ in range(n)]
    train, holdout, other = rows_of(150), rows_of(130), rows_of(60)
    frame = lambda rs: spark.createDataFrame(rs, schema)
    noisy = [(None if x is None else x + float(rng.normal()) * 1e-4, t) for x, t in train]
    for synth in (other, noisy, train[:75] + other):
        got = nearest.membership_attack(frame(train), frame(holdout), frame(synth), ["x", "t"]).first()
        want = attack_by_pairs(spark, train, holdout, synth)
        assert (got["members"], got["others"]) == (150, 130)
        assert np.allclose([got["auc"], got["std_error"], got["advantage"]], want, atol=1e-8), (got, want)
        assert np.isclose(got["z"], (want[0] - 0.5) / want[1])


def test_membership_attack_of_extremes(spark):
    wide = lambda lo, n, step=1.0: spark.range(n).selectExpr(f"{lo} + id * {step} AS x", "'a' AS t")
    sure = nearest.membership_attack(wide(0, 40), wide(0.5, 40), wide(0, 40), ["x", "t"]).first()
    assert sure["auc"] == 1.0 and sure["advantage"] == 1.0 and sure["std_error"] == 0.0 and sure["z"] is None
    same = nearest.membership_attack(wide(0, 40), wide(0, 40), wide(0, 3), ["x", "t"]).first()
    assert abs(same["auc"] - 0.5) < 1e-12 and same["advantage"] == 0.0
    none = wide(0, 0)
    assert nearest.membership_attack(none, wide(0, 4), wide(0, 4), ["x", "t"]).first()[:3] == (0, 4, None)
    assert nearest.membership_attack(wide(0, 4), none, wide(0, 4), ["x", "t"]).first()["auc"] is None
    assert nearest.membership_attack(wide(0, 4), wide(0, 4), none, ["x", "t"]).first()["auc"] is None
    assert nearest.membership_attack(wide(0, 1), wide(2, 1), wide(0, 1), ["x", "t"]).first()[2:4] == (1.0, None)
