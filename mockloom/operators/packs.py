"""Points packed many to a row: how tables of coordinates are kept and moved by the searches for closest records.

A row holds the points of one task that go to the same place, column by column and byte by
byte, compressed: a third of what the points take as rows.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that a task packs at a time.
PACKED = 100_000
#: Combinations of texts up to which points are sorted by them first.
COMBINATIONS = 4096


def point_tools(kinds: list[bool], words: dict[int, np.ndarray] | None = None, unseen: dict[int, np.ndarray] | None = None) -> SimpleNamespace:
    """Functions of points, a NumPy array for each column. They go to the tasks whole, as these need not know this package.

    ``words`` are all coordinates of texts of few values, in order, ``unseen`` those that no real point has.
    """
    d, words, unseen = len(kinds), words or {}, unseen or {}
    most_combinations = COMBINATIONS

    def pack(columns: list[np.ndarray]) -> bytes:
        n = len(columns[0])
        planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
        return pa.compress(b"".join(planes), codec="zstd", asbytes=True)

    def unpack(data, n: int, types: str) -> list[np.ndarray]:
        """The ``n`` values of each column; ``types`` has a letter of NumPy's for each."""
        sizes = [np.dtype(t).itemsize for t in types]
        raw, out, at = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd"), np.uint8), [], 0
        for t, k in zip(types, sizes, strict=True):
            out.append(np.ascontiguousarray(raw[at:at + n * k].reshape(k, n).T).view(t).ravel())
            at += n * k
        return out

    def rows_of(batches, types: str, data: str = "data", number: str = "n"):
        """Columns of each packed row that is not empty, with its batch and place there."""
        for batch in batches:
            sizes = batch.column(number).to_numpy()
            for k in range(batch.num_rows):
                if sizes[k]:
                    yield batch, k, unpack(batch.column(data)[k].as_buffer(), int(sizes[k]), types)

    def read(batches, asked: str) -> list[list[np.ndarray]]:
        """Slots and points of a task, of the real table (side 0) and of the other, with more columns of the types ``asked``; nothing for a side without rows."""
        sides = [[], []]
        for batch in batches:
            side, n = batch.column("side").to_numpy(), batch.column("n").to_numpy()
            for k in range(batch.num_rows):
                sides[side[k]].append(unpack(batch.column("data")[k].as_buffer(), int(n[k]), "i" + "d" * d + (asked if side[k] else "")))
        return [[np.concatenate(c) for c in zip(*side, strict=True)] for side in sides]

    def gathered(batches, most: int):
        """Columns of plain batches, so many rows together."""
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= most:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
        if size:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def hashed(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def firsts(columns: list[np.ndarray]) -> np.ndarray:
        """Which rows differ from the one before."""
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            bits = c.view(np.int64)
            new[1:] |= bits[1:] != bits[:-1]
        return new

    def thinned(xs: list[np.ndarray], weights: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Most of the repeated points put together, by one sort."""
        order = np.argsort(hashed(xs), kind="stable")
        xs = [c[order] for c in xs]
        at = np.flatnonzero(firsts(xs))
        return [c[at] for c in xs], [np.add.reduceat(w[order], at) for w in weights]

    def zorder(columns: list[np.ndarray], bits: int) -> np.ndarray:
        """Position on a Z-order curve of so many bits."""
        used = columns[:bits]
        each, out = max(1, min(31, bits // max(1, len(used)))), np.zeros(len(columns[0]) if columns else 1, np.int64)
        for i, c in enumerate(used):
            g = np.clip(np.nan_to_num(c) * float(2**each), 0, 2**each - 1).astype(np.int64)
            for b in range(each):
                out |= (g >> b & 1) << (b * len(used) + i)
        return out

    def curve(xs: list[np.ndarray]) -> np.ndarray:
        """Position by texts of few values first, as points of other texts are far away, then along a curve; only the packing quality depends on it."""
        front, size, rest = np.zeros(len(xs[0]), np.int64), 1, []
        for i, c in enumerate(xs):
            values = len(words.get(i, ())) + 1
            if i in words and size * values <= most_combinations:
                front, size = front * values + np.searchsorted(words[i], c, "right"), size * values
            else:
                rest.append(c)
        bits = 62 - size.bit_length()
        return (front << bits | zorder(rest, bits)) if rest else front

    def pattern(xs: list[np.ndarray]) -> np.ndarray:
        """Bits of the columns whose value is at the same distance from all real ones, but for their nulls: numbers that are null, texts that no real row has."""
        out = np.zeros(len(xs[0]), np.int64)
        for i, c in enumerate(xs[:62]):
            out |= (np.isin(c, unseen[i]) if i in unseen else np.zeros(len(c), bool) if kinds[i] else c < 0).astype(np.int64) << i
        return out

    def bare(xs: list[np.ndarray], p: int) -> list[np.ndarray]:
        """The points without the values of the columns of a pattern: what is left of a number is whether it is null."""
        return [c if not p >> i & 1 else np.zeros(len(c)) if kinds[i] else np.where(c < 0, c, 0.0) for i, c in enumerate(xs)]

    def gaps(x: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
        """Squared lower bounds of how far coordinates are from any of stretches that may hold nulls; the distances where ``low`` is ``high``."""
        total = 0.0
        for i, text in enumerate(kinds):
            a, lo, hi = x[i], low[i], high[i]
            if text:
                total = total + ((a != lo) if lo is hi else (a < lo) | (a > hi))
            elif lo is hi and not ((a < 0).any() or (lo < 0).any()):
                gap = a - lo
                total = total + gap * gap
            else:
                known = np.maximum(np.maximum(np.where(lo < 0, 0.0, lo - a), a - hi), 0.0)
                gap = np.where(a < 0, np.where(lo < 0, 0.0, 1.0), np.where(hi < 0, 1.0, known))
                total = total + gap * gap
        return total

    def reach(x: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
        """The same for all of some points at once."""
        total = 0.0
        for i, text in enumerate(kinds):
            least, most = x[i].min(), x[i].max()
            if text:
                total = total + ((most < low[i]) | (least > high[i]))
            elif least >= 0:
                gap = np.where(high[i] < 0, 1.0, np.maximum(np.maximum(np.where(low[i] < 0, 0.0, low[i] - most), least - high[i]), 0.0))
                total = total + gap * gap
        return total

    return SimpleNamespace(**{k: v for k, v in locals().items() if callable(v)}, d=d)


def packed(df: DataFrame, kinds: list[bool], weights: list[str], most: int = PACKED) -> DataFrame:
    """Points x0.. and the whole numbers ``weights`` of a table, packed; within a row no point comes twice."""
    tools, d = point_tools(kinds), len(kinds)

    def run(batches):
        for columns in tools.gathered(batches, most):
            xs, ws = tools.thinned([c + 0.0 for c in columns[:d]], columns[d:])
            yield pa.RecordBatch.from_arrays([pa.array([len(xs[0])], pa.int32()), pa.array([tools.pack([*xs, *ws])], pa.binary())], names=["n", "data"])

    return df.select(*[f"x{i}" for i in range(d)], *[F.col(w).cast("bigint").alias(w) for w in weights]).mapInArrow(run, "n int, data binary")


def unpacked(df: DataFrame, kinds: list[bool], types: str, schema: str) -> DataFrame:
    """Packed points as rows; ``types`` has a letter of NumPy's for each column."""
    tools = point_tools(kinds)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for _, _, columns in tools.rows_of(batches, types):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return df.mapInArrow(run, schema)
