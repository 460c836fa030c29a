"""Differentially private releases: which groups exist, and counts, sums, means and quantiles of them, under one budget.

A user is the unit of privacy. Each counts in a bounded number of groups, with
bounded values. Noise follows from a secret seed and the group, so a rerun of a
lost task gives the same numbers; who knows the seed can take the noise off.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import exp, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mockloom.functions.rng import uniform

#: Cells of equal width among which a quantile is chosen.
CELLS = 1024


class BudgetSpent(ValueError):
    """A release would go over the budget."""


@dataclass
class Ledger:
    """What releases on the same users have cost so far."""

    epsilon: float
    delta: float = 0.0
    charges: list[tuple[str, float, float]] = field(default_factory=list)

    def charge(self, what: str, epsilon: float, delta: float = 0.0) -> None:
        """Book a release; refused, and not booked, if all of them would cost more than the budget."""
        if epsilon <= 0 or delta < 0:
            raise ValueError("a release costs a positive epsilon and no negative delta")
        made = [*self.charges, (what, epsilon, delta)]
        if not self._within(made):
            raise BudgetSpent(f"{what} does not fit into what is left of the budget")
        self.charges = made

    def _within(self, charges: Sequence[tuple[str, float, float]]) -> bool:
        spent = sum(c[2] for c in charges)
        if spent > self.delta * (1 + 1e-12):
            return False
        return composed([c[1] for c in charges], max(self.delta - spent, 0.0)) <= self.epsilon * (1 + 1e-12)

    def spent(self) -> tuple[float, float]:
        """(epsilon, delta) of all releases so far; delta that they leave over helps to add up epsilons."""
        spent = sum(c[2] for c in self.charges)
        total = sum(c[1] for c in self.charges)
        least = composed([c[1] for c in self.charges], max(self.delta - spent, 0.0))
        return (total, spent) if least >= total else (least, self.delta)


def composed(epsilons: Sequence[float], slack: float) -> float:
    """Epsilon of releases together: their sum, or less at the price of ``slack`` (Kairouz, Oh and Viswanath's heterogeneous composition)."""
    total = sum(epsilons)
    if slack <= 0 or not epsilons:
        return total
    drift, squares = sum(e * (exp(e) - 1) / (exp(e) + 1) for e in epsilons), sum(e * e for e in epsilons)
    return min(total, drift + sqrt(2 * squares * log(1 / slack)), drift + sqrt(2 * squares * log(exp(1) + sqrt(squares) / slack)))


def threshold(epsilon: float, delta: float, max_groups: int) -> float:
    """Noisy number of users from which a group may be named: one user's groups all stay below it but with probability ``delta``."""
    return 1 + max_groups / epsilon * log(max_groups / (2 * delta))


def name_of(group: Column) -> Column:
    """What a group's noise follows from."""
    return F.coalesce(group.cast("string"), F.lit("(null)"))


def laplace(scale: float, seed: int | str, what: str, group: Column) -> Column:
    """Laplace noise of a group."""
    centred = uniform(seed, "dp", what, group) - 0.5
    # u = 0 would give log(0); the smallest positive step stands in
    inner = F.greatest(F.lit(1.0) - F.abs(centred) * 2, F.lit(2.0**-32))
    return -F.signum(centred) * scale * F.log(inner)


def bounded(df: DataFrame, user: str, group: str, max_groups: int, value: str | None = None) -> DataFrame:
    """(u, g) or (u, g, s, a): a user's groups, ``max_groups`` at most, chosen by hash order; sum and average of the user's values there.

    Spark keeps no more than ``max_groups`` rows of a user in any task when it
    ranks them, also of one with a large part of all rows. Rows without user are left out; a null group is a group.
    """
    values = [] if value is None else [F.sum(value).alias("s"), F.avg(value).alias("a")]
    per = df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("u"), F.col(group).alias("g"))
    per = per.agg(*values) if values else per.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    name = F.concat_ws("|", F.col("u").cast("string"), F.col("g").cast("string"))
    order = Window.partitionBy("u").orderBy(F.md5(name), "g")
    return per.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_groups).drop("_r")


@dataclass
class Release:
    """What to release of each group. ``low`` and ``high`` bound a user's value; quantiles are given by their share."""

    user: str
    group: str
    value: str
    low: float
    high: float
    max_groups: int
    quantiles: Sequence[float] = (0.5,)

    def _sums(self, per: DataFrame) -> DataFrame:
        clip = lambda c: F.least(F.greatest(c, F.lit(self.low)), F.lit(self.high))
        middle = (self.low + self.high) / 2
        return per.groupBy("g").agg(
            F.count(F.lit(1)).alias("users"), F.count("a").alias("valued"), F.coalesce(F.sum(clip(F.col("s"))), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(clip(F.col("a")) - middle), F.lit(0.0)).alias("off"))

    def _quantile(self, per: DataFrame, share: float, epsilon: float, seed: int | str) -> DataFrame:
        """(g, q): the cell end chosen by the exponential mechanism among CELLS.

        Cells without values between two others are equally good and stand in one
        row, weighted by their number. A group has at most CELLS + 1 rows in its window.
        """
        width = (self.high - self.low) / CELLS
        cell = F.least(F.greatest(F.floor((F.col("a") - self.low) / width), F.lit(0)), F.lit(CELLS - 1)).cast("int")
        counts = per.where("a is not null").groupBy("g", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        zero = counts.select("g").distinct().select("g", F.lit(0).alias("cell"), F.lit(0).cast("bigint").alias("n"))
        counts = counts.unionByName(zero).groupBy("g", "cell").agg(F.sum("n").alias("n"))
        of = Window.partitionBy("g")
        placed = counts.select(
            "g", "cell", F.sum("n").over(of.orderBy("cell")).alias("below"), F.sum("n").over(of).alias("all"),
            (F.lead("cell", 1, CELLS).over(of.orderBy("cell")) - F.col("cell")).alias("run"))
        key = F.concat_ws("|", name_of(F.col("g")), F.col("cell").cast("string"))
        drawn = F.greatest(uniform(seed, "dp", f"{self.group}#q{share}", key), F.lit(2.0**-33))
        good = -F.abs(F.col("below") - F.col("all") * share) * (epsilon / self.max_groups / 2)
        best = placed.withColumn("score", good + F.log("run") - F.log(-F.log(drawn)))
        chosen = best.groupBy("g").agg(F.max_by(F.struct("cell", "run"), F.struct("score", "cell")).alias("c"))
        inside = F.floor(uniform(seed, "dp", f"{self.group}#i{share}", name_of(F.col("g"))) * F.col("c.run"))
        return chosen.select("g", (F.lit(self.low) + (F.col("c.cell") + inside + 1) * width).alias("q"))

    def run(self, df: DataFrame, ledger: Ledger, epsilon: float, delta: float, seed: int | str) -> DataFrame:
        """(group_value, noisy_users, noisy_sum, noisy_mean, q50...) of the groups that may be named.

        ``epsilon`` is shared evenly by the users, the sum, the mean and each quantile; ``delta`` pays for
        naming groups. All is booked before anything is read. A group is named
        if its noisy number of users reaches ``threshold``; others leave no trace.
        """
        part = epsilon / (3 + len(self.quantiles))
        ledger.charge("users and names of groups", part, delta)
        for what in ("sums", "means", *[f"quantile {q}" for q in self.quantiles]):
            ledger.charge(what, part)
        noise = lambda what, scale: laplace(scale, seed, f"{self.group}#{what}", name_of(F.col("g")))
        per = bounded(df, self.user, self.group, self.max_groups, self.value)
        largest, half = max(abs(self.low), abs(self.high)), (self.high - self.low) / 2
        c = self.max_groups
        sums = self._sums(per).withColumn("noisy_users", F.col("users") + noise("users", c / part))
        named = sums.where(F.col("noisy_users") >= threshold(part, delta, c))
        mean = (self.low + self.high) / 2 + (F.col("off") + noise("off", 2 * c * half / part)) / F.greatest(F.lit(1.0), F.col("valued") + noise("n", 2 * c / part))
        out = named.select(
            "g", "noisy_users", (F.col("total") + noise("sum", c * largest / part)).alias("noisy_sum"),
            F.least(F.greatest(mean, F.lit(self.low)), F.lit(self.high)).alias("noisy_mean"))
        for q in self.quantiles:
            found = self._quantile(per, q, part, seed).select(F.col("g").alias("_g"), F.col("q").alias(f"q{q * 100:g}".replace(".", "_")))
            out = out.join(found, F.col("g").eqNullSafe(F.col("_g")), "left").drop("_g")
        return out.withColumnRenamed("g", "group_value")
