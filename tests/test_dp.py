"""Private releases."""

import math

import pytest
from pyspark.sql import functions as F

from mockloom.operators import dp, privacy


def test_ledger_adds_up_and_refuses():
    ledger = dp.Ledger(1.0, 1e-6)
    ledger.charge("a", 0.4, 5e-7)
    ledger.charge("b", 0.6)
    with pytest.raises(dp.BudgetSpent):
        ledger.charge("c", 0.01)
    assert [c[0] for c in ledger.charges] == ["a", "b"] and ledger.spent()[0] == pytest.approx(1.0)
    with pytest.raises(dp.BudgetSpent):
        dp.Ledger(1.0, 1e-6).charge("too much delta", 0.1, 1e-5)
    with pytest.raises(ValueError):
        ledger.charge("nothing", 0.0)


def test_many_small_releases_cost_less_than_their_sum():
    many = [0.01] * 1000
    assert dp.composed(many, 0.0) == pytest.approx(10.0)
    assert dp.composed(many, 1e-6) == pytest.approx(0.01 * math.tanh(0.005) * 1000 + math.sqrt(2 * 0.1 * math.log(1e6)), rel=0.2) and dp.composed(many, 1e-6) < 2
    ledger = dp.Ledger(2.0, 1e-6)
    for k in range(1000):
        ledger.charge(str(k), 0.01)
    assert ledger.spent()[0] < 2 and ledger.spent()[1] == 1e-6


@pytest.fixture(scope="module")
def visits(spark):
    """4,000 users in two large groups, one user in groups of their own, one group of five, and a user with very many rows."""
    rows = spark.range(4000).select(F.col("id").alias("user"), F.array(F.lit("big"), F.lit("other")).alias("g"), (F.col("id") % 100).cast("double").alias("v"))
    rows = rows.select("user", F.explode("g").alias("place"), "v")
    lone = spark.range(200).select(F.lit(5000).cast("bigint").alias("user"), F.concat(F.lit("lone "), "id").alias("place"), F.lit(1e9).alias("v"))
    five = spark.range(5).select((F.col("id") + 6000).alias("user"), F.lit("five").alias("place"), F.lit(None).cast("double").alias("v"))
    hot = spark.range(30_000).select(F.lit(7000).cast("bigint").alias("user"), F.lit("big").alias("place"), F.lit(1e6).alias("v"))
    return rows.unionByName(lone).unionByName(five).unionByName(hot)


def test_small_groups_are_not_named(visits):
    for seed in range(5):
        got = {r["group_value"] for r in privacy.dp_counts(visits, "user", "place", 1.0, 2, seed, 1e-6).collect()}
        assert got == {"big", "other"}
    alone = visits.where("user = 5000 or user >= 6000 and user < 7000")
    assert privacy.dp_counts(alone, "user", "place", 1.0, 2, 1, 1e-6).count() == 0


def test_release_is_near_the_truth_and_bounded(visits):
    release, ledger = dp.Release("user", "place", "v", 0.0, 100.0, 2, (0.25, 0.5)), dp.Ledger(10.0, 1e-6)
    got = {r["group_value"]: r for r in release.run(visits, ledger, 10.0, 1e-6, "secret").collect()}
    assert set(got) == {"big", "other"} and ledger.spent() == (pytest.approx(10.0), 1e-6)
    for r in got.values():
        assert abs(r["noisy_users"] - 4000) < 30
        assert abs(r["noisy_sum"] - 4000 * 49.5) < 3000
        assert abs(r["noisy_mean"] - 49.5) < 1 and abs(r["q25"] - 25) < 3 and abs(r["q50"] - 50) < 3
    with pytest.raises(dp.BudgetSpent):
        release.run(visits, ledger, 0.1, 1e-7, "secret")
    again = {r["group_value"]: r for r in release.run(visits.repartition(7), dp.Ledger(10.0, 1e-6), 10.0, 1e-6, "secret").collect()}
    assert again.keys() == got.keys() and all(abs(again[g]["noisy_mean"] - got[g]["noisy_mean"]) < 1e-9 for g in got)


def test_noise_has_its_scale(spark):
    noise = spark.range(20_000).select(dp.laplace(3.0, 1, "x", F.col("id").cast("string")).alias("z"))
    mean, size = noise.agg(F.avg("z"), F.avg(F.abs("z"))).first()
    assert abs(mean) < 0.1 and abs(size - 3) < 0.1


def test_quantile_follows_the_exponential_mechanism(spark):
    """Over many groups of equal values, the chosen cells have the shares that the mechanism gives them."""
    df = spark.range(3000).select(F.col("id").alias("g"), F.explode(F.array(*[F.lit(v) for v in (0.1, 0.3, 0.3, 0.9)])).alias("v")).withColumn("user", F.monotonically_increasing_id())
    release = dp.Release("user", "g", "v", 0.0, 1.0, 1)
    per = dp.bounded(df, "user", "g", 1, "v")
    got = [r["q"] for r in release._quantile(per, 0.5, 4.0, 3).collect()]
    below = lambda q: sum(v < q - 1e-12 for v in (0.1, 0.3, 0.3, 0.9))
    weight = [math.exp(-abs(below((k + 1) / dp.CELLS) - 2) * 2.0) for k in range(dp.CELLS)]
    mean = sum((k + 1) / dp.CELLS * w for k, w in enumerate(weight)) / sum(weight)
    assert len(got) == 3000 and abs(sum(got) / 3000 - mean) < 0.02


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (1, None, 1.0), (2, None, None)], "user bigint, place string, v double")
    release = dp.Release("user", "place", "v", 0.0, 1.0, 1)
    got = release.run(df, dp.Ledger(1000.0, 0.4), 1000.0, 0.4, 1).collect()
    assert [r["group_value"] for r in got] == [None] and abs(got[0]["noisy_users"] - 2) < 0.5
    assert release.run(df.limit(0), dp.Ledger(1.0, 0.1), 1.0, 0.1, 1).count() == 0
