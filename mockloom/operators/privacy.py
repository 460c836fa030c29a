"""Leakage, anonymity, noise and masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mockloom.operators import dp


def leakage_rate(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Distinct joined rows (nulls match nulls) over the number of synthetic rows.

    Both sides shrink to distinct rows before the join. Where a side has columns
    of its own, a key met r times in real and s times in synth stands for r x s
    joined rows; these are counted, never produced.
    """
    shared = [c for c in real.columns if c in synth.columns]

    def combos(df: DataFrame, name: str) -> DataFrame:
        rows = df.distinct()
        if len(df.columns) == len(shared):
            return rows.select(*shared, F.lit(1).cast("bigint").alias(name))
        return rows.groupBy(*shared).agg(F.count(F.lit(1)).alias(name))

    left, right = combos(real, "_r").alias("l"), combos(synth, "_s").alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in shared])
    hits = left.join(right, on).select((F.col("_r") * F.col("_s")).alias("hits"), F.lit(0).cast("bigint").alias("rows"))
    rows = synth.select(F.lit(0).cast("bigint").alias("hits"), F.lit(1).cast("bigint").alias("rows"))
    return (
        hits.unionByName(rows)
        .agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("shared_rows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("synthetic_rows"))
        .withColumn("leakage_rate", F.coalesce(F.try_divide(F.col("shared_rows"), F.col("synthetic_rows")), F.lit(0.0)))
    )


# fixed values: advice below and from the limit
ADVICE = ("Proceed", "Use Differential Privacy")


def privacy_audit(real: DataFrame, synth: DataFrame, limit: float = 0.05) -> DataFrame:
    """Leakage rate with status and advice."""
    safe = F.col("leakage_rate") < limit
    return leakage_rate(real, synth).select(
        "leakage_rate",
        F.when(safe, "safe").otherwise("risk").alias("status"),
        F.when(safe, ADVICE[0]).otherwise(ADVICE[1]).alias("recommendation"),
    )


def generalise(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Replace quasi-identifiers by coarser expressions before grouping."""
    return df.withColumns(rules)


def k_anonymity(df: DataFrame, k: int, quasi: list[str]) -> DataFrame:
    """Rows whose quasi-identifier group has at least k members; nulls form groups.

    Groups below k are few-rowed by definition, so they are what is looked up;
    the rows of a large group are dealt by the join alone, which the adaptive
    skew join can split.
    """
    small = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < k).select(*quasi)
    same = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in quasi])
    return df.alias("d").join(small.alias("s"), same, "left_anti")


def dp_counts(
    df: DataFrame, user: str, group: str, epsilon: float, max_groups: int, seed: int | str, delta: float = 1e-6
) -> DataFrame:
    """Users per group with Laplace noise of scale max_groups / epsilon, of groups whose noisy number reaches a threshold.

    A user counts once per group and in at most ``max_groups`` groups. A group
    of few users is not named at all, so that its presence tells nothing: for one
    user that holds but with probability ``delta``. Only the noisy number leaves;
    ``seed`` must be kept secret, as the noise follows from it. See ``dp`` for more
    than counts and for a budget over several releases.
    """
    exact = dp.bounded(df, user, group, max_groups).groupBy("g").agg(F.count(F.lit(1)).alias("bounded_users"))
    noisy = F.col("bounded_users") + dp.laplace(max_groups / epsilon, seed, group, dp.name_of(F.col("g")))
    out = exact.select(F.col("g").alias("group_value"), noisy.alias("noisy_users"))
    return out.where(F.col("noisy_users") >= dp.threshold(epsilon, delta, max_groups))


# fixed values: what counts as personal data, one pattern per class
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+?[0-9]{1,3}[ -][(]?[0-9]{2,4}[)]?[ -][0-9]{3,4}[ -][0-9]{3,4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b",
}


def pii_scan(df: DataFrame, text: str) -> DataFrame:
    """Matches and touched rows per class over whole texts."""
    names = list(PII_PATTERNS)
    hits = df.select(*[F.regexp_count(F.col(text), F.lit(PII_PATTERNS[n])).alias(n) for n in names])
    return (
        hits.unpivot([], names, "pii_class", "n")
        .groupBy("pii_class")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count_if(F.col("n") > 0).alias("rows_with_match"))
    )


def pii_mask(text: Column) -> Column:
    """Every match replaced by its class token, in the order of the table above."""
    for name, pattern in PII_PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"<{name.upper()}>")
    return text


CIPHERS = {"AES-128": 16, "AES-256": 32}


def encrypt_columns(df: DataFrame, cols: dict[str, str], keys: DataFrame, mode: str = "GCM") -> DataFrame:
    """Base64 of the AES-encrypted columns; other algorithms are refused.

    ``keys`` is a table of one row and one text column. The key travels as data
    and shows in no plan or event log.
    """
    for algorithm in cols.values():
        if algorithm not in CIPHERS:
            raise ValueError(f"{algorithm} is not offered; choose one of {sorted(CIPHERS)}")
    lock = lambda c, a: F.base64(F.aes_encrypt(F.col(c).cast("string"), _key(a), F.lit(mode)))
    return _with_key(df, keys).withColumns({c: lock(c, a) for c, a in cols.items()}).drop(_SECRET)


def decrypt_columns(df: DataFrame, cols: dict[str, str], keys: DataFrame, mode: str = "GCM") -> DataFrame:
    unlock = lambda c, a: F.aes_decrypt(F.unbase64(c), _key(a), F.lit(mode)).cast("string")
    return _with_key(df, keys).withColumns({c: unlock(c, a) for c, a in cols.items()}).drop(_SECRET)


_SECRET = "_secret"


def _with_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Every row with the key beside it; one row is broadcast."""
    return df.crossJoin(F.broadcast(keys.limit(1).toDF(_SECRET)))


def _key(algorithm: str) -> Column:
    size = CIPHERS[algorithm]
    raw = F.col(_SECRET).cast("binary")
    short = F.raise_error(F.lit(f"{algorithm} needs a key of at least {size} bytes")).cast("binary")
    return F.when(F.octet_length(raw) >= size, F.substring(raw, 1, size)).otherwise(short)
