"""Exact ranks of many columns without sorting them whole.

A sample on the driver suggests cuts for each column. One pass counts the values at each cut and
between cuts, in both tables: after that ranks are known at all cuts, and only the values between some of the
cuts have to be moved and sorted, packed and in tasks of bounded size. Whatever the sample, results are exact.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.operators.packs import point_tools

#: Cuts of a column, sampled rows for each, values of a task about, and rows that a task counts or packs at a time.
CUTS, SAMPLED, TOGETHER, ROWS = 4096, 16, 1_000_000, 100_000


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, made without Python tasks."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    table = pa.table({n: pa.array(c, kind[f.split()[1]]) for n, f, c in zip(names, schema.split(", "), columns, strict=True)})
    return spark.createDataFrame(table, schema)


def _slot_tools(cuts: list[np.ndarray]) -> SimpleNamespace:
    """Functions that go to the tasks whole, as these need not know this package."""
    def slots(i: int, values: np.ndarray) -> np.ndarray:
        """2k + 1 for a value at cut k, 2k for one below it and above the last."""
        at = np.searchsorted(cuts[i], values)
        return 2 * at + (cuts[i][np.minimum(at, len(cuts[i]) - 1)] == values if len(cuts[i]) else 0)

    def known(column) -> np.ndarray:
        values = column.to_numpy(zero_copy_only=False).astype(float)
        return values[~np.isnan(values)]

    return SimpleNamespace(slots=slots, known=known)


class Slices:
    """Numbers of values by column, table and slot. ``sides`` are tables of the same columns, all doubles; nulls and NaN are left out."""

    def __init__(self, sides: list[DataFrame]):
        self.columns, self.spark = sides[0].columns, sides[0].sparkSession
        d, seen = len(self.columns), []
        for df in sides:
            size = df.count()
            seen.append(df.sample(min(1.0, CUTS * SAMPLED / max(size, 1)), 7).toArrow())
        self.cuts = []
        for i in range(d):
            values = np.concatenate([s.column(i).to_numpy().astype(float) for s in seen])
            values = np.sort(values[~np.isnan(values)])
            self.cuts.append(np.unique(values[len(values) * np.arange(CUTS) // CUTS]) if len(values) else values)
        self.both = sides[0].withColumn("_side", F.lit(0))
        for k, df in enumerate(sides[1:], 1):
            self.both = self.both.unionByName(df.withColumn("_side", F.lit(k)))
        cuts, tools, many = self.cuts, _slot_tools(self.cuts), len(sides)

        def count(batches):
            counts = [np.zeros((many, 2 * len(c) + 1), np.int64) for c in cuts]
            for batch in batches:
                if batch.num_rows:
                    side = batch.column(d)[0].as_py()  # a batch is of one table
                    for i in range(d):
                        counts[i][side] += np.bincount(tools.slots(i, tools.known(batch.column(i))), minlength=counts[i].shape[1])
            for i, c in enumerate(counts):
                side, slot = np.nonzero(c)
                numbers = [np.full(len(slot), i, np.int32), side.astype(np.int32), slot.astype(np.int32), c[side, slot]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], names=["i", "side", "slot", "n"])

        found = self.both.mapInArrow(count, "i int, side int, slot int, n bigint").groupBy("i", "side", "slot").agg(F.sum("n").alias("n")).toArrow()
        self.counts = [np.zeros((many, 2 * len(c) + 1), np.int64) for c in cuts]
        i, side, slot, n = (found[c].to_numpy() for c in ("i", "side", "slot", "n"))
        for k in range(d):
            own = i == k
            self.counts[k][side[own], slot[own]] = n[own]

    def within(self, wanted: list[np.ndarray], work, schema: str) -> pa.Table:
        """What ``work`` makes of the values of ``wanted`` slots of each column, in order: it gets their numbers among all wanted (from 0), the values and a count for each table."""
        d, many, tools, packs = len(self.columns), len(self.counts[0]), _slot_tools(self.cuts), point_tools([False])
        number, size = [], 0
        for w, c in zip(wanted, self.counts, strict=True):
            number.append(np.full(c.shape[1], -1, np.int64))
            number[-1][w] = size + np.arange(len(w))
            size += len(w)
        total = sum(int(c[:, w].sum()) for w, c in zip(wanted, self.counts, strict=True))
        parts = max(1, min(size, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) if total > ROWS else 1, -(-total // TOGETHER))))
        types, names = "id" + "q" * many, [f.split()[0] for f in schema.split(", ")]

        def merged(at: np.ndarray, values: np.ndarray, counts: list[np.ndarray]):
            order = np.lexsort((values, at))
            at, values = at[order], values[order]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (values[1:] != values[:-1])]))
            return at[new], values[new], [np.add.reduceat(c[order], new) for c in counts]

        def deal(batches):
            held = []

            def rows():
                at, values, side = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                at, values, counts = merged(at, values, [(side == k).astype(np.int64) for k in range(many)])
                order = np.argsort(at % parts, kind="stable")
                part = (at % parts)[order]
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(begin[1:], len(part))
                columns = [c[order] for c in (at.astype(np.int32), values, *counts)]
                data = [packs.pack([c[a:b] for c in columns]) for a, b in zip(begin, ends, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array((ends - begin).astype(np.int32)), pa.array(data, pa.binary())], names=["part", "n", "data"])

            waiting = 0
            for batch in batches:
                for i in range(d if batch.num_rows else 0):
                    values = tools.known(batch.column(i))
                    at = number[i][tools.slots(i, values)]
                    chosen = np.flatnonzero(at >= 0)
                    if len(chosen):
                        held.append((at[chosen], values[chosen], np.full(len(chosen), batch.column(d)[0].as_py(), np.int8)))
                        waiting += len(chosen)
                if waiting > ROWS:
                    yield rows()
                    waiting = 0
            if held:
                yield rows()

        def run(batches):
            held = [columns for _, _, columns in packs.rows_of(batches, types)]
            if held:
                at, values, *counts = (np.concatenate(c) for c in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(*merged(at, values, counts))], names=names)

        return self.both.mapInArrow(deal, "part int, n int, data binary").repartitionById(parts, "part").mapInArrow(run, schema).toArrow()


def largest_gaps(slices: Slices) -> list[tuple[float | None, int, int]]:
    """Largest distance between the distribution functions of two tables and their numbers of values, by column.

    The distance is known at the cuts. Between two it is at most what all values of one table before all
    of the other make, so most stretches cannot hold a larger one; where a table has no values it is largest at an end.
    """
    wanted, out, before, column = [], [], [], []
    for c in slices.counts:
        sums, n = c.cumsum(axis=1), c.sum(axis=1)
        if not n.all():
            wanted.append(np.zeros(0, np.int64))
            out.append(None)
            continue
        (a, b), (a0, b0) = sums / n[:, None], (sums - c) / n[:, None]
        out.append(float(np.abs(a - b).max()))
        inner = (np.arange(c.shape[1]) % 2 == 0) & (c > 0).all(axis=0)
        wanted.append(np.flatnonzero(inner & (np.maximum(a - b0, b - a0) > out[-1])))
        before.append((sums - c)[:, wanted[-1]])
        column.append(np.full(len(wanted[-1]), len(wanted) - 1))
    if sum(map(len, wanted)):
        before, column, whole = np.concatenate(before, axis=1), np.concatenate(column), np.array([c.sum(axis=1) for c in slices.counts])

        def gaps(at, values, counts):
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            share = []
            for k, c in enumerate(counts):
                sums = np.cumsum(c)
                first = np.repeat(sums[begin] - c[begin], np.diff(np.append(begin, len(at))))
                share.append((before[k][at] + sums - first) / whole[column[at], k])
            return column[at[begin]].astype(np.int32), np.maximum.reduceat(np.abs(share[0] - share[1]), begin)

        found = slices.within(wanted, gaps, "i int, gap double")
        for i, gap in zip(found["i"].to_pylist(), found["gap"].to_pylist(), strict=True):
            out[i] = max(out[i], gap)
    return [(gap, *map(int, c.sum(axis=1))) for gap, c in zip(out, slices.counts, strict=True)]


def values_at(slices: Slices, ranks: list[np.ndarray]) -> list[list[float]]:
    """The values of one table that stand at some places of each column in order, counted from 1."""
    out, wanted, asked, base = [], [], [], 0
    for i, (c,) in enumerate(slices.counts):
        sums = np.cumsum(c)
        slot = np.searchsorted(sums, ranks[i])
        out.append([float(slices.cuts[i][s // 2]) if s % 2 else None for s in slot])
        wanted.append(np.unique(slot[slot % 2 == 0]))
        asked += [(base + int(np.searchsorted(wanted[i], s)), int(r - (sums[s] - c[s])), i, k) for k, (s, r) in enumerate(zip(slot, ranks[i], strict=True)) if s % 2 == 0]
        base += len(wanted[i])
    if asked:
        places = np.array(asked)

        def picked(at, values, counts):
            sums = np.cumsum(counts[0])
            own = places[np.isin(places[:, 0], at)]
            begin = np.searchsorted(at, own[:, 0])
            found = np.searchsorted(sums, own[:, 1] + sums[begin] - counts[0][begin])
            return own[:, 2].astype(np.int32), own[:, 3].astype(np.int32), values[found]

        found = slices.within(wanted, picked, "i int, k int, value double")
        for i, k, value in zip(*(found[c].to_pylist() for c in ("i", "k", "value")), strict=True):
            out[i][k] = value
    return out
