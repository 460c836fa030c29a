"""Counter-based random numbers.

A value depends only on (seed, table, column, row id), so a lost task can be
run again and a table can be cut into any number of partitions without
changing a single value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def u32(seed: int | str, table: str, column: str, row: Column) -> Column:
    """Uniform integer in [0, 2**32): the first 32 bits of an MD5 over the counter."""
    key = F.concat(F.lit(f"{seed}|{table}|{column}|"), row.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(seed, table: str, column: str, row: Column) -> Column:
    """Uniform double in [0, 1)."""
    return u32(seed, table, column, row) / F.lit(TWO_32)


def normal(seed, table: str, column: str, row: Column) -> Column:
    """Standard normal by Box-Muller; the first uniform is kept off zero."""
    u1 = (u32(seed, table, column + "#a", row) + F.lit(1)) / F.lit(TWO_32 + 1.0)
    u2 = u32(seed, table, column + "#b", row) / F.lit(TWO_32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def normal_bits(seed, table: str, row: Column, count: int) -> list[Column]:
    """64-bit hashes of a row, each of which gives two of ``count`` independent standard normals."""
    return [F.xxhash64(F.lit(f"{seed}|{table}|{k}"), row) for k in range((count + 1) // 2)]


def normals(seed, table: str, row: Column, count: int) -> list[Column]:
    """Independent standard normals for one row: each 64-bit hash gives two. Faster than ``normal``, but no other engine has this hash."""
    out = []
    for h in normal_bits(seed, table, row, count):
        u1 = (F.shiftrightunsigned(h, 32) + F.lit(1)) / F.lit(TWO_32 + 1.0)
        angle = F.lit(6.283185307179586) * (h.bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(TWO_32))
        radius = F.sqrt(F.lit(-2.0) * F.log(u1))
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out[:count]


def normals_of(count: int):
    """``normals`` as a function of hashes held in arrays. It goes to the tasks whole, as they need not know this package."""

    def normals(bits: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for h in bits:
            h = h.view(np.uint64)
            radius = np.sqrt(-2.0 * np.log(((h >> np.uint64(32)).astype(float) + 1) / (TWO_32 + 1.0)))
            angle = 6.283185307179586 * ((h & np.uint64(0xFFFFFFFF)).astype(float) / TWO_32)
            out += [radius * np.cos(angle), radius * np.sin(angle)]
        return out[:count]

    return normals


def pick(words: list[str], seed, table: str, column: str, row: Column) -> Column:
    """One of the given words."""
    index = u32(seed, table, column, row) % F.lit(len(words)) + F.lit(1)
    return F.element_at(F.array(*[F.lit(w) for w in words]), index.cast("int"))
