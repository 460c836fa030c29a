"""Draws from distributions as column expressions of a counter.

Gamma, beta, Poisson and truncated normal values come from rejection sampling:
try ``t`` of a row has random numbers of its own, counted by (row, t), so a
value needs no state and comes out alike in any partition. A try is accepted
more often than not, and later tries are not evaluated once one was; that all
``TRIES`` are refused has a chance below 1e-19 and is an error, not a value.
Methods: Marsaglia and Tsang (gamma), Hoermann's transformed rejection
(Poisson from a mean of 10), Robert (truncated normal).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mockloom.functions.rng import TWO_32, u32

TRIES = 64

# fixed values: constants of Hoermann's sampler, and the coefficients of Stirling's series
PTRS = {"b": (0.931, 2.53), "a": (-0.059, 0.02483), "inv_alpha": (1.1239, 1.1328, 3.4), "v_r": (0.9277, 3.6224, 2.0), "shift": 0.43, "quick": 0.07, "edge": 0.013}
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


def open_uniform(seed, stream: str, row: Column) -> Column:
    """Uniform double strictly between 0 and 1."""
    return (u32(seed, "prior", stream, row) + F.lit(0.5)) / F.lit(TWO_32)


def _normal(seed, stream: str, row: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(open_uniform(seed, stream + "#r", row)))
    return radius * F.cos(F.lit(6.283185307179586) * open_uniform(seed, stream + "#w", row))


def _accepted(attempt: Callable[[Column], Column]) -> Column:
    """The first try that is not null; ``attempt`` takes the number of the try."""
    first = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda held, t: F.coalesce(held, attempt(t)))
    return F.coalesce(first, F.raise_error(F.lit("no try was accepted")).cast("double"))


def _let(values: list[Column], then: Callable[..., Column]) -> Column:
    """``then`` of the values, each worked out once."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(named), lambda s: then(*[s[f"v{i}"] for i in range(len(values))])), 0)


def _count(key: Column, t: Column) -> Column:
    return F.concat_ws("|", key, t.cast("string"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1 by Stirling's series at x + 8; error below 1e-11."""
    y = x + 8.0
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series / (y * y) + c
    lowered = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series / y - lowered


def gamma(seed, stream: str, key: Column, shape: Column) -> Column:
    """Gamma value of scale 1; a shape below 1 is drawn one higher and brought down by a power of a uniform."""
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3.0
    c = F.lit(1.0) / F.sqrt(d * 9.0)

    def attempt(t: Column) -> Column:
        at = _count(key, t)

        def judged(x: Column, d: Column, v: Column) -> Column:
            fits = F.log(open_uniform(seed, stream + "#u", at)) < x * x * 0.5 + d - d * v + d * F.log(v)
            return F.when(v > 0, F.when(fits, d * v))

        return _let([_normal(seed, stream, at), d, c], lambda x, d, c: _let([x, d, F.pow(c * x + 1.0, F.lit(3.0))], judged))

    lift = F.when(shape < 1, F.pow(open_uniform(seed, stream + "#l", key), F.lit(1.0) / shape)).otherwise(1.0)
    return _accepted(attempt) * lift


def beta(seed, key: Column, a: Column, b: Column) -> Column:
    """Share of one gamma value in the sum of two."""
    return _let([gamma(seed, "beta#a", key, a), gamma(seed, "beta#b", key, b)], lambda x, y: x / (x + y))


def poisson(seed, key: Column, mean: Column) -> Column:
    """Number of events: by summing probabilities for a mean below 10, by rejection from there."""
    u = open_uniform(seed, "poisson", key)
    start = F.struct(F.lit(0.0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cum"))

    def step(s: Column, k: Column) -> Column:
        # below a mean of 10 the sum passes every possible uniform before k = 64
        p = s["p"] * mean / k.cast("double")
        ahead = F.struct(k.cast("double").alias("k"), p.alias("p"), (s["cum"] + p).alias("cum"))
        return F.when(s["cum"] >= u, s).otherwise(ahead)

    small = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["k"])
    b = F.sqrt(mean) * PTRS["b"][1] + PTRS["b"][0]
    a = b * PTRS["a"][1] + PTRS["a"][0]
    inv_alpha = F.lit(PTRS["inv_alpha"][1]) / (b - PTRS["inv_alpha"][2]) + PTRS["inv_alpha"][0]
    v_r = F.lit(PTRS["v_r"][0]) - F.lit(PTRS["v_r"][1]) / (b - PTRS["v_r"][2])

    def attempt(t: Column) -> Column:
        at = _count(key, t)

        def judged(us: Column, v: Column, k: Column, a: Column, b: Column) -> Column:
            fits = F.log(v) + F.log(inv_alpha) - F.log(a / (us * us) + b) <= k * F.log(mean) - mean - log_gamma(k + 1.0)
            return F.when((us >= PTRS["quick"]) & (v <= v_r), k).when((k < 0) | ((us < PTRS["edge"]) & (v > us)), None).when(fits, k)

        def placed(w: Column, v: Column, a: Column, b: Column) -> Column:
            us = F.lit(0.5) - F.abs(w)
            return _let([us, v, F.floor((a * 2.0 / us + b) * w + mean + PTRS["shift"]).cast("double"), a, b], judged)

        return _let([open_uniform(seed, "poisson#w", at) - 0.5, open_uniform(seed, "poisson#v", at), a, b], placed)

    return F.when(mean < 10, small).otherwise(_accepted(attempt))


def truncated_normal(seed, key: Column, mean: Column, deviation: Column, low: Column, high: Column) -> Column:
    """Normal value between two bounds, either of which may be infinite or null (none), however far in the tail."""
    infinite = float("inf")
    lo = (F.coalesce(low, F.lit(-infinite)) - mean) / deviation
    hi = (F.coalesce(high, F.lit(infinite)) - mean) / deviation
    turned = hi < 0  # both bounds below the mean: drawn above it and turned back
    near, far = F.when(turned, -hi).otherwise(lo), F.when(turned, -lo).otherwise(hi)
    root = F.sqrt(near * near + 4.0)
    rate = (near + root) / 2.0
    narrow = F.when(near > 0, far - near <= F.lit(2.0) * F.exp((near * near - near * root) / 4.0 + 0.5) / (near + root)).otherwise(far - near <= 2.5066282746310002)

    def attempt(t: Column) -> Column:
        at = _count(key, t)
        u, log_v = open_uniform(seed, "truncated", at), F.log(open_uniform(seed, "truncated#v", at))
        peak = F.when(near > 0, near * near).otherwise(0.0)
        return (
            F.when(narrow, _let([near + (far - near) * u], lambda z: F.when(log_v <= (peak - z * z) / 2.0, z)))
            .when(near > 0, _let([near - F.log(u) / rate], lambda z: F.when((z <= far) & (log_v <= (z - rate) * (rate - z) / 2.0), z)))
            .otherwise(_let([_normal(seed, "truncated", at)], lambda z: F.when((z >= near) & (z <= far), z)))
        )

    z = _accepted(attempt)
    return mean + deviation * F.when(turned, -z).otherwise(z)


def categorical(seed, key: Column, weights: Column) -> Column:
    """0-based index into ``weights``, each drawn by its share of their sum; a weight of zero is never drawn."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    goal = open_uniform(seed, "categorical", key) * total
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("last"), F.lit(0.0).alias("cum"))

    def step(s: Column, w: Column) -> Column:
        i = s["i"] + 1
        passed = (s["cum"] < goal) & (w > 0)
        return F.struct(i.alias("i"), F.when(passed, i).otherwise(s["last"]).alias("last"), (s["cum"] + w).alias("cum"))

    return F.aggregate(weights, start, step, lambda s: s["last"].cast("double"))
