"""Children that follow their parents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mockloom.operators import copula, fidelity, generate, hierarchy
from mockloom.plans import flows

A = lambda n, t, *c: {"name": n, "type": t, "constraints": list(c)}
SCHEMA = {"databases": [{"tables": [
    {"name": "k", "attributes": [A("kid", "BIGINT", "PRIMARY_KEY"), A("pid", "BIGINT", "FOREIGN_KEY_REFERENCES_p.id"), A("other", "BIGINT", "FOREIGN_KEY_REFERENCES_p.id")]},
    {"name": "p", "attributes": [A("id", "BIGINT", "PRIMARY_KEY")]},
    {"name": "g", "attributes": [A("gid", "BIGINT", "PRIMARY_KEY"), A("kid", "BIGINT", "FOREIGN_KEY_REFERENCES_k.kid")]}]}]}


@pytest.fixture(scope="module")
def family(spark):
    """Parents with a hidden mean that their own column, their number of children and the children's columns follow."""
    r, parents, kids, grand = random.Random(3), [], [], []
    for p in range(1, 1001):
        m, n = r.gauss(0, 1), 0 if r.random() < 0.3 else None
        n = max(1, int(r.gauss(8 + 3 * m, 2))) if n is None else n
        parents.append((p, m + r.gauss(0, 0.3), "a" if r.random() < 0.6 else "b"))
        for _ in range(n):
            v = 2 * m + r.gauss(0, 1)
            kids.append((len(kids) + 1, p if r.random() < 0.95 else None, r.randint(1, 1000), v, None if r.random() < 0.1 else v * 3 + r.gauss(0, 1), "x" if v + r.gauss(0, 1) > 0 else "y"))
            grand += [(len(grand) + k + 1, len(kids), v + r.gauss(0, 0.3)) for k in range(r.randint(1, 3))]
    real = {
        "p": spark.createDataFrame(parents, "id bigint, m double, kind string"),
        "k": spark.createDataFrame(kids, "kid bigint, pid bigint, other bigint, v double, w double, s string"),
        "g": spark.createDataFrame(grand, "gid bigint, kid bigint, z double")}
    made = flows.scale_up(spark, SCHEMA, real, {t: df.count() for t, df in real.items()}, 2.0)
    return real, {t: df.cache() for t, df in made.items()}


def within(df, fk, c):
    groups = df.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(c).alias("n"), F.var_pop(c).alias("v")).agg(F.sum(F.col("n") * F.col("v")) / F.sum("n")).first()[0]
    return groups / df.agg(F.var_pop(c)).first()[0]


def test_keys_and_sizes(family):
    real, made = family
    assert all(made[t].dtypes == real[t].dtypes for t in real)
    assert made["p"].count() == 2000
    for t, key in (("p", "id"), ("k", "kid"), ("g", "gid")):
        n = made[t].count()
        assert abs(n / real[t].count() - 2) < 0.1
        assert made[t].agg(F.min(key), F.max(key), F.count_distinct(key)).first() == (1, n, n)
    for child, fk, parent, key in (("k", "pid", "p", "id"), ("k", "other", "p", "id"), ("g", "kid", "k", "kid")):
        orphans = made[child].where(F.col(fk).isNotNull()).join(made[parent].select(F.col(key).alias("_key")), F.col(fk) == F.col("_key"), "left_anti")
        assert orphans.count() == 0
    assert abs(made["k"].where("pid is null").count() / made["k"].count() - 0.05) < 0.02


def test_children_follow_their_parents(family):
    real, made = family
    counts = [copula.child_counts(side["p"], "id", side["k"].withColumnRenamed("pid", "fk"), "fk").select("children") for side in (real, made)]
    assert fidelity.ks_statistic(*counts, ["children"]).first()["statistic"] < 0.05
    for child, fk, c in (("k", "pid", "v"), ("k", "pid", "w"), ("g", "kid", "z")):
        assert abs(within(real[child], fk, c) - within(made[child], fk, c)) < 0.1
        assert within(real[child], fk, c) < 0.5
    for a, b, on, left, right in (("k", "p", F.col("pid") == F.col("id"), "v", "m"), ("g", "k", "kid", "v", "z")):
        got = [side[a].join(side[b], on).stat.corr(left, right) for side in (real, made)]
        assert abs(got[0] - got[1]) < 0.1
    for t, columns in (("p", ["m", "kind"]), ("k", ["v", "w", "s"]), ("g", ["z"])):
        assert all(r["score"] < 0.06 for r in fidelity.audit_quality(real[t].select(columns), made[t].select(columns)).collect())


def test_variance_is_split():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 9, 4000)
    of = np.repeat(np.arange(4000), sizes)
    centre = r.normal(0, [0.8, 0.3, 0.0], (4000, 3))
    z = centre[of] + r.normal(0, [0.6, 0.9, 1.0], (len(of), 3))
    means = np.stack([np.bincount(of, z[:, k]) / sizes for k in range(3)], axis=1) - z.mean(axis=0)
    n = np.full((3, 3), float(len(of)))
    s = np.repeat(z.sum(axis=0)[:, None], 3, axis=1)
    between, rest = hierarchy.split_variance(n, s, z.T @ z, (means * sizes[:, None]).T @ means, float(len(of)), float((sizes**2).sum()), 4000)
    assert np.allclose(np.diag(between), [0.64, 0.09, 0.0], atol=0.04) and np.allclose(np.diag(rest), [0.36, 0.81, 1.0], atol=0.04)
    one, none = hierarchy.split_variance(n, s, z.T @ z, np.zeros((3, 3)), 10.0, 10.0, 10)
    assert not none.any() and one[0, 0] > 0
    assert not hierarchy.split_variance(n, s, z.T @ z, np.zeros((3, 3)), 10.0, 100.0, 1)[0].any()


def test_lonely_and_empty_tables(spark):
    real = {
        "p": spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None)], "id bigint, m double, kind string"),
        "k": spark.createDataFrame([], "kid bigint, pid bigint, other bigint, v double"),
        "g": spark.createDataFrame([], "gid bigint, kid bigint, z double")}
    made = flows.scale_up(spark, SCHEMA, real, {"p": 3, "k": 0, "g": 0}, 4.0)
    assert (made["p"].count(), made["k"].count(), made["g"].count()) == (12, 0, 0)
    chain = {"p": real["p"], "k": real["p"].selectExpr("id as kid", "id as pid", "id as other", "m * 2 as v")}
    made = flows.scale_up(spark, SCHEMA, chain, {"p": 3, "k": 3}, 40.0)
    assert made["k"].count() == 120 and made["k"].select("pid").distinct().count() == 120


def test_unique_strings_are_looked_up_in_linear_time(spark):
    real = spark.range(30_000).select(F.concat(F.lit("name "), "id").alias("name"), (F.col("id") % 7).cast("string").alias("few"))
    made = copula.fit(real).sample(spark, 20_000)
    assert made.count() == 20_000 and made.join(real, "name", "left_anti").count() == 0
    assert made.select("name").distinct().count() > 12_000


def test_unknown_priors_are_refused(spark):
    ids = spark.range(3).withColumnRenamed("id", "row")
    known = spark.createDataFrame([("a", "Normal", 1.0, 0.0)], "column_name string, dist_type string, p1 double, p2 double")
    assert {r["value"] for r in generate.sample_priors(ids, "row", known).collect()} == {1.0}
    for kind in ("weibull", None):
        with pytest.raises(Exception, match="no such distribution"):
            generate.sample_priors(ids, "row", known.withColumn("dist_type", F.lit(kind))).collect()
