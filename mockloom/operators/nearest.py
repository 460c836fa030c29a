"""Distance to the closest record, exact or by random projections, without comparing all pairs.

Real points are cut into blocks along a space-filling curve, where a sample of them
says, and each block into leaves, all with tight bounds, whatever the density of the data. A synthetic
point is searched in the block it lies in, then in those whose bounds lie nearer than
the point already found, which are few, however many records there are. One task
holds a few blocks and a bounded number of the points that ask for each. Points are kept and moved packed.

Columns may be numbers or text. Numbers are scaled to [0, 1] and differ by
their distance, texts by 0 or 1; with ``nulls`` a null equals a null and differs from all else by 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.operators.packs import packed, point_tools, unpacked
from mockloom.operators.scan import dense_index, discard, lookup_by_key, running_totals, settled

#: Real points of a block (about) and of a leaf in it, and synthetic points that meet a block in one task (about).
BLOCK, LEAF, ASKED = 16_384, 64, 100_000
#: Points of a block in the sample that tells where to cut, and blocks of a task at most.
SEEN, TOGETHER = 32, 32
#: Sets of columns without a value to compare whose points are searched apart.
PATTERNS = 4
#: Values of a text column up to which they are sent to all tasks.
WORDS = 10_000
#: Points of both tables in one task of an approximate search (about), and up to which there is no second one.
BESIDE, ALONE = 400_000, 20_000
#: Coordinate of a null.
NULL = -1.0
#: Random rotations of an approximate search, and real points before and after a synthetic one that it is compared with in each.
ROTATIONS, REACH = 2, 48


Bounds = list[tuple[float, float]]


def common_bounds(frames: list[DataFrame], cols: list[str]) -> Bounds:
    """Range of each column over all the given tables: two numbers per column."""
    both = reduce(lambda a, b: a.unionByName(b), [f.select(*[F.col(c).cast("double").alias(c) for c in cols]) for f in frames])
    row = both.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(cols))]


def _scaled(df: DataFrame, cols: list[str], bounds: Bounds) -> DataFrame:
    complete = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()

    def at(i: int) -> Column:
        low, high = bounds[i]
        return (F.col(f"x{i}") - low) / (high - low) if low is not None and high > low else F.lit(0.0)

    return complete.select(*[at(i).alias(f"x{i}") for i in range(len(cols))])


def text_columns(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]


def mixed_points(real: DataFrame, synth: DataFrame, cols: list[str], *keep: str) -> tuple[DataFrame, DataFrame, list[bool], list[dict[int, np.ndarray]]]:
    """Both tables as coordinates x0.., nulls as NULL, which of them are text, and of columns with few texts the coordinates
    of all and of those that no real row has; the second table with the columns to ``keep`` as well.

    A text's coordinate is its place among all texts of the column, so that texts
    that stand together in a node cover a short stretch.
    """
    texts = text_columns(real, cols)
    numbers = [c for c in cols if c not in texts]
    bounds = dict(zip(numbers, common_bounds([real, synth], numbers), strict=True)) if numbers else {}
    sides = [df.select(*[F.col(c).cast("string" if c in texts else "double").alias(f"x{i}") for i, c in enumerate(cols)], *more) for df, more in ((real, ()), (synth, keep))]
    words = [{}, {}]
    for i, c in enumerate(cols):
        if c in texts:
            both = sides[0].select(f"x{i}", F.lit(True).alias("_real")).union(sides[1].select(f"x{i}", F.lit(False))).dropna()
            placed = dense_index(both.groupBy(f"x{i}").agg(F.max("_real").alias("_real")), [f"x{i}"], "_place")
            size = max(placed.count(), 1)
            codes = placed.select(f"x{i}", ((F.col("_place") + 0.5) / size).alias("_code"), "_real")
            if size <= WORDS:
                rows = codes.select("_code", "_real").orderBy("_code").collect()
                words[0][i], words[1][i] = (np.array([r["_code"] for r in rows if not (seen and r["_real"])], dtype=float) for seen in (False, True))
            sides = [_coded(df, codes.drop("_real"), f"x{i}", size <= WORDS) for df in sides]
        else:
            low, high = bounds[c]
            at = (F.col(f"x{i}") - low) / (high - low) if low is not None and high > low else F.lit(0.0)
            sides = [df.withColumn(f"x{i}", F.when(F.col(f"x{i}").isNull() | F.isnan(f"x{i}"), NULL).otherwise(at)) for df in sides]
    xs = [f"x{i}" for i in range(len(cols))]
    return sides[0].select(*xs), sides[1].select(*xs, *keep), [c in texts for c in cols], words


def _coded(df: DataFrame, codes: DataFrame, name: str, few: bool) -> DataFrame:
    if few:
        return df.join(F.broadcast(codes), name, "left").withColumn(name, F.coalesce("_code", F.lit(NULL))).drop("_code")
    found = lookup_by_key(df.where(F.col(name).isNotNull()), codes, [name]).withColumn(name, F.col("_code")).drop("_code")
    return found.unionByName(df.where(F.col(name).isNull()).withColumn(name, F.lit(NULL)))


def closest(real: DataFrame, synth: DataFrame, cols: list[str], bounds: Bounds | None = None, nulls: bool = False) -> DataFrame:
    """Distinct scaled synthetic points (x0..) with their row count and distance to the nearest real point.

    Columns are scaled to [0, 1] over both tables, or over ``bounds`` (numbers
    only). Without ``nulls``, rows with a null in any column have no distance and are left out.
    """
    if nulls or text_columns(real, cols):
        known = (lambda df: df) if nulls else (lambda df: df.dropna(subset=cols))
        left, right, kinds, words = mixed_points(known(real), known(synth), cols)
    else:
        bounds = common_bounds([real, synth], cols) if bounds is None else bounds
        left, right, kinds, words = _scaled(real, cols, bounds), _scaled(synth, cols, bounds), [False] * len(cols), []
    return _nearest(left, right.withColumn("weight", F.lit(1)), kinds, words, ["weight"])


def _tree(sample: list[np.ndarray], kinds: list[bool], most: int) -> tuple[np.ndarray, ...]:
    """Halves of a sample, cut where it is widest, down to ``most`` points: column and value of each cut, its two sides, and the block of an end.

    Boxes of such blocks lie apart, so that few points are near to more than one. Sides with and without nulls and texts of few values come first.
    """
    def width(i: int, x: np.ndarray) -> float:
        low, high = x.min(), x.max()
        return 0.0 if low == high else 2 * min(1.0, 64 / len(np.unique(x))) if kinds[i] else 2.0 if low < 0 else high - low

    nodes, todo, blocks = [[0, 0.0, 0, 0, 0]], [(0, np.arange(len(sample[0])))], 0
    while todo:
        at, rows = todo.pop()
        widths = [width(i, x[rows]) for i, x in enumerate(sample)] if len(rows) > most else [0.0]
        if not max(widths) > 0:
            nodes[at] = [0, np.inf, at, at, blocks]
            blocks += 1
            continue
        i = int(np.argmax(widths))
        x = sample[i][rows]
        cut = np.partition(x, len(x) // 2)[len(x) // 2]
        if not kinds[i] and x.min() < 0:
            cut = x[x >= 0].min()
        elif cut == x.min():
            cut = x[x > cut].min()
        nodes[at] = [i, cut, len(nodes), len(nodes) + 1, 0]
        todo += [(len(nodes) + k, rows[side]) for k, side in enumerate((x < cut, x >= cut))]
        nodes += [[0, 0.0, 0, 0, 0], [0, 0.0, 0, 0, 0]]
    column, cut, low, high, block = zip(*nodes, strict=True)
    return np.array(column), np.array(cut, float), np.array([low, high]), np.array(block)


def _homing(tools, patterns: list[int], trees: list[tuple], first: np.ndarray):
    """Functions that give points their blocks. A block lies in one of the spaces that are searched apart, one for each of ``patterns``."""
    def block(bare: list[np.ndarray], space: int) -> np.ndarray:
        column, cut, sides, ends = trees[space]
        x, rows = np.stack(bare), np.arange(len(bare[0]))
        at = np.zeros(len(rows), np.int64)
        while True:
            below = sides[(x[column[at], rows] >= cut[at]).astype(np.int64), at]
            if (below == at).all():
                return first[space] + ends[at]
            at = below

    def home(xs: list[np.ndarray]) -> np.ndarray:
        found, out = tools.pattern(xs), block(xs, 0)
        for space, p in enumerate(patterns[1:], 1):
            own = np.flatnonzero(found == p)
            if len(own):
                out[own] = block(tools.bare([x[own] for x in xs], p), space)
        return out

    return block, home


def _packing(tools):
    """Function of points and their slots: a packed row for each of the ``parts`` tasks that some of the points go to."""
    def rows(slot: np.ndarray, columns: list[np.ndarray], side: int, parts: int) -> pa.RecordBatch:
        order = np.lexsort((tools.curve(columns[:tools.d]), slot, slot % parts))
        slot, columns = slot[order], [c[order] for c in columns]
        part = slot % parts
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(at[1:], len(part))
        data = [tools.pack([slot[a:b].astype(np.int32), *[c[a:b] for c in columns]]) for a, b in zip(at, ends, strict=True)]
        numbers = [pa.array(c.astype(np.int32)) for c in (part[at], np.full(len(at), side), ends - at)]
        return pa.RecordBatch.from_arrays([*numbers, pa.array(data, pa.binary())], names=["part", "side", "n", "data"])

    return rows


_DEALT = "part int, side int, n int, data binary"


def _search(tools, leaf_rows: int, types: str, patterns: list[int], first: np.ndarray, block_of: np.ndarray, lows: list[np.ndarray], highs: list[np.ndarray]):
    """Functions that hold the points of a task against the real ones of the blocks they ask for.

    ``types`` has letters for the weights. ``block_of`` gives the block of each slot. Least distances are squared.
    """
    d = tools.d

    def nearest(xs: list[np.ndarray], at: np.ndarray, real: list[np.ndarray], best: np.ndarray):
        """Lowers ``best`` of points along the curve, where ``at`` is their place, by the real points of a block; yields which were done."""
        where = tools.curve(real)
        order = np.argsort(where, kind="stable")
        order = np.concatenate([order, np.repeat(order[-1:], -len(order) % leaf_rows)])
        starts = where[order[::leaf_rows]]
        leaves = [x[order].reshape(-1, leaf_rows) for x in real]
        low, high = [x.min(axis=1) for x in leaves], [x.max(axis=1) for x in leaves]

        def held(who: np.ndarray, leaf: np.ndarray) -> None:
            for k in range(0, len(who), 4096):
                w, some = who[k:k + 4096], [x[leaf[k:k + 4096]] for x in leaves]
                np.minimum.at(best, w, tools.gaps([x[w][:, None] for x in xs], some, some).min(axis=1))

        for a in range(0, len(at), 128):
            who = np.arange(a, min(a + 128, len(at)))
            part = [x[who] for x in xs]
            own = np.maximum(np.searchsorted(starts, at[who], "right") - 1, 0)
            held(who, own)
            near = np.flatnonzero(tools.reach(part, low, high) < best[who].max())
            if len(near):
                bound = tools.gaps([x[:, None] for x in part], [x[near] for x in low], [x[near] for x in high])
                bound[own[:, None] == near[None]] = np.inf
                # the most promising leaf, then all that could hold something as close
                leaf = bound.argmin(axis=1)
                some = np.flatnonzero(bound[np.arange(len(who)), leaf] < best[who])
                held(who[some], near[leaf[some]])
                bound[some, leaf[some]] = np.inf
                some, leaf = np.nonzero(bound < best[who][:, None])
                held(who[some], near[leaf])
            yield who, part

    def met(real: list[np.ndarray], asked: list[np.ndarray]):
        """For each slot: its block, the space of the block, its real points, and the places of those that ask."""
        order = [np.argsort(side[0], kind="stable") if side else np.zeros(0, int) for side in (real, asked)]
        slots = [side[0][o] if side else np.zeros(0, np.int32) for side, o in zip((real, asked), order, strict=True)]
        for slot in np.unique(slots[1]):
            (a, b), (c, e) = (np.searchsorted(s, [slot, slot + 1]) for s in slots)
            held, block = order[0][a:b], int(block_of[slot])
            yield block, int(np.searchsorted(first, block, "right")) - 1, [x[held] for x in real[1:]] if real else [np.zeros(0)] * d, order[1][c:e]

    def others(part: list[np.ndarray], best: np.ndarray, block: int, space: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = first[space], first[space + 1]
        lo, hi = [x[a:b] for x in lows], [x[a:b] for x in highs]
        near = np.flatnonzero(tools.reach(part, lo, hi) < best.max())
        near = near[near != block - a]
        open_ = tools.gaps([x[:, None] for x in part], [x[near] for x in lo], [x[near] for x in hi]) < best[:, None]
        return open_.sum(axis=1), (a + near)[np.nonzero(open_)[1]]

    def at_home(batches):
        """Points with their weights added up and their least distance at home, packed; those that other blocks may be nearer to apart, with the blocks."""
        real, asked = tools.read(batches, types)
        held = []

        def rows():
            xs, best, n, more = ([np.concatenate(c) for c in zip(*[h[0] for h in held], strict=True)], *[np.concatenate([h[k] for h in held]) for k in (1, 2, 3)])
            out = []
            for open_, chosen in ((False, np.flatnonzero(n == 0)), (True, np.flatnonzero(n))):
                if len(chosen):
                    columns = [*[x[chosen] for x in xs], best[chosen], *([n[chosen].astype(np.int32)] if open_ else [])]
                    out.append({"open": open_, "n": len(chosen), "data": tools.pack(columns), "m": len(more) if open_ else 0, "more": tools.pack([more]) if open_ else b""})
            held.clear()
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("open", pa.bool_()), ("n", pa.int32()), ("data", pa.binary()), ("m", pa.int32()), ("more", pa.binary())]))

        size = many = 0
        for block, space, points, who in met(real, asked):
            columns = [c[who] for c in asked[1:]]
            at = tools.curve(tools.bare(columns[:d], patterns[space]))
            order = np.lexsort((*columns[:d], at))
            columns, at = [c[order] for c in columns], at[order]
            new = np.flatnonzero(tools.firsts(columns[:d]))
            columns, at = [*[c[new] for c in columns[:d]], *[np.add.reduceat(w, new) for w in columns[d:]]], at[new]
            best = np.full(len(new), np.inf)
            if not len(points[0]):
                raise ValueError(f"block {block} has no real points")
            for k, part in nearest(columns[:d], at, points, best):
                n, more = others(part, best[k], block, space)
                held.append(([c[k] for c in columns], best[k], n, more.astype(np.int32)))
                size, many = size + len(k), many + len(more)
                if size > 50_000 or many > 1_000_000:
                    yield rows()
                    size = many = 0
        if held:
            yield rows()

    def elsewhere(batches):
        """Least distances of points at home and in one more block, as rows."""
        real, asked = tools.read(batches, types + "d")
        for _, space, points, who in met(real, asked):
            columns = [c[who] for c in asked[1:]]
            at = tools.curve(tools.bare(columns[:d], patterns[space]))
            order = np.argsort(at, kind="stable")
            columns, at = [c[order] for c in columns], at[order]
            for _ in nearest(columns[:d], at, points, columns[-1]):
                pass
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))])

    return at_home, elsewhere


def _tasks(spark, slots: int) -> int:
    return max(1, min(slots, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // TOGETHER))))


def _slots(asked: np.ndarray, idle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Into how many slots each block goes (``idle`` if no points ask for it), the number of its first, and the block of each slot."""
    shares = np.maximum(idle, -(-asked // ASKED))
    return shares, np.cumsum(shares) - shares, np.repeat(np.arange(len(shares)), shares)


def _sample(sides: list[tuple[DataFrame, str]], tools, step: int) -> list[np.ndarray]:
    """About one of ``step`` distinct points of packed tables, on the driver: a few for each block."""
    out = []
    for df, types in sides:
        def some(batches, types=types):
            for _, _, columns in tools.rows_of(batches, types):
                chosen = np.flatnonzero(tools.hashed(columns[:tools.d]) % np.uint64(step) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in columns[:tools.d]], names=[f"x{i}" for i in range(tools.d)])

        rows = df.mapInArrow(some, ", ".join(f"x{i} double" for i in range(tools.d))).distinct().toArrow()
        out.append(np.column_stack([c.to_numpy() for c in rows.columns]).reshape(-1, tools.d))
    return out


def _nearest(left: DataFrame, points: DataFrame, kinds: list[bool], words: list[dict[int, np.ndarray]], weights: list[str]) -> DataFrame:
    """The distinct points with their ``weights`` added up and the distance to the nearest of ``left``; null if there is none.

    Real points go to the tasks of their blocks, and points to the block they lie in; then points that could have something
    nearer elsewhere, and real points again, to the blocks these ask for. A block that many ask is handed to several tasks.

    To a point whose number is null it only matters whether a real one's is; one whose text no real row has is as far
    from all of them. So points that share such columns, if there are many, are held against real points without the values of these columns.
    """
    spark, d, tools = left.sparkSession, len(kinds), point_tools(kinds, *words)
    xs = [f"x{i}" for i in range(d)]
    whole = ", ".join([*[f"{x} double" for x in xs], *[f"{w} bigint" for w in weights]])
    types, letters = "d" * d + "q" * len(weights), "q" * len(weights)
    real, asked = settled(packed(left, kinds, []), True), settled(packed(points, kinds, weights), True)
    step = max(1, BLOCK // SEEN)
    known, seen = _sample([(real, "d" * d), (asked, types)], tools, step)
    found, n = np.unique(tools.pattern(list(seen.T)), return_counts=True)
    patterns = [0, *[p for _, p in sorted((-k, p) for k, p in zip(n.tolist(), found.tolist(), strict=True) if p)[:PATTERNS]]]
    trees = [_tree(tools.thinned(tools.bare([np.ascontiguousarray(x) for x in known.T], p), [])[0], kinds, max(1, BLOCK // step)) if len(known) else _tree([np.zeros(1)] * d, kinds, 1) for p in patterns]
    first = np.cumsum([0, *[t[-1].max() + 1 for t in trees]])  # block of each space, and their number
    block, home = _homing(tools, patterns, trees, first)

    def bounds(batches):
        low, high = (np.full((d, first[-1]), end) for end in (np.inf, -np.inf))
        for _, _, columns in tools.rows_of(batches, "d" * d):
            for space, p in enumerate(patterns):
                bare = tools.bare(columns, p)
                at = block(bare, space)
                for i in range(d):
                    np.minimum.at(low[i], at, bare[i])
                    np.maximum.at(high[i], at, bare[i])
        used = np.flatnonzero(low[0] < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(x[used]) for x in (*low, *high)]], names=names)

    names = ["block", *[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)]]
    ends = real.mapInArrow(bounds, ", ".join(["block int", *[f"{n} double" for n in names[1:]]]))
    ends = ends.groupBy("block").agg(*[F.min(n).alias(n) for n in names[1:d + 1]], *[F.max(n).alias(n) for n in names[d + 1:]]).toArrow()  # a row for BLOCK points
    if not ends.num_rows:
        every = unpacked(asked, kinds, types, whole).groupBy(*xs).agg(*[F.sum(w).alias(w) for w in weights])
        return every.withColumn("distance", F.lit(None).cast("double"))
    lows, highs = ([np.full(first[-1], end) for _ in range(d)] for end in (np.inf, -np.inf))
    for i in range(d):
        lows[i][ends["block"].to_numpy()], highs[i][ends["block"].to_numpy()] = ends[f"lo{i}"].to_numpy(), ends[f"hi{i}"].to_numpy()

    rows_for, share = _packing(tools), lambda columns: (tools.hashed(columns[:d]) >> np.uint64(20)).astype(np.int64)

    def dealt(shares: np.ndarray, begin: np.ndarray, parts: int):
        def run(batches):
            for _, _, columns in tools.rows_of(batches, "d" * d):
                for space, p in enumerate(patterns):
                    bare = tools.thinned(tools.bare(columns, p), [])[0] if p else columns
                    at = block(bare, space)
                    copies = shares[at]
                    who = np.repeat(np.arange(len(at)), copies)
                    if len(who):
                        yield rows_for((begin[at] - np.cumsum(copies) + copies)[who] + np.arange(len(who)), [x[who] for x in bare], 0, parts)

        return run

    # at home
    shares, begin, block_of = _slots(np.bincount(home(list(seen.T)), minlength=first[-1]) * step, 1)
    parts = _tasks(spark, len(block_of))

    def homed(batches, shares=shares, begin=begin, parts=parts):
        for _, _, columns in tools.rows_of(batches, types):
            at = home(columns[:d])
            yield rows_for(begin[at] + share(columns) % shares[at], columns, 1, parts)

    met = real.mapInArrow(dealt(shares, begin, parts), _DEALT).unionByName(asked.mapInArrow(homed, _DEALT)).repartitionById(parts, "part")
    at_home, _ = _search(tools, LEAF, letters, patterns, first, block_of, lows, highs)
    near = settled(met.mapInArrow(at_home, "open boolean, n int, data binary, m int, more binary"), True)
    discard(asked)
    done = unpacked(near.where("not open"), kinds, types + "d", whole + ", best double")

    # elsewhere
    def wanted(batches):
        total = np.zeros(first[-1], np.int64)
        for _, _, (more,) in tools.rows_of(batches, "i", "more", "m"):
            total += np.bincount(more, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["block", "n"])

    total, asks = np.zeros(first[-1], np.int64), near.where("open").mapInArrow(wanted, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).toArrow()
    total[asks["block"].to_numpy()] = asks["n"].to_numpy()
    if total.any():
        shares, begin, block_of = _slots(total, 0)
        parts = _tasks(spark, len(block_of))

        def sent(batches):
            for batch, k, columns in tools.rows_of(batches, types + "di"):
                more, = tools.unpack(batch.column("more")[k].as_buffer(), batch.column("m")[k].as_py(), "i")
                who = np.repeat(np.arange(len(columns[0])), columns[-1])
                for a in range(0, len(who), 200_000):
                    w, at = who[a:a + 200_000], more[a:a + 200_000]
                    yield rows_for(begin[at] + share(columns)[w] % shares[at], [c[w] for c in columns[:-1]], 1, parts)

        met = real.mapInArrow(dealt(shares, begin, parts), _DEALT).unionByName(near.where("open").mapInArrow(sent, _DEALT)).repartitionById(parts, "part")
        _, elsewhere = _search(tools, LEAF, letters, patterns, first, block_of, lows, highs)
        rows = met.mapInArrow(elsewhere, ", ".join([*[f"c{i} double" for i in range(d)], *[f"c{d + i} bigint" for i in range(len(weights))], f"c{d + len(weights)} double"]))
        rows = rows.toDF(*xs, *weights, "best")
        done = done.unionByName(rows.groupBy(*xs, *weights).agg(F.min("best").alias("best")))
    return done.withColumn("distance", F.sqrt("best")).drop("best")


def _turned(tools, kinds: list[bool], out: int | None, turn: np.ndarray, shift: np.ndarray):
    """Function of points: what they are sorted by in one turn, the first last."""
    d, numbers = tools.d, [i for i, text in enumerate(kinds) if not text and i != out]
    room = 2 * len(numbers)**0.5 + 1

    def keys(xs: list[np.ndarray]) -> list[np.ndarray]:
        # what two points share or not: texts, and whether a number is null
        shared = [x if kinds[i] else (x < 0).astype(float) for i, x in enumerate(xs) if i != out]
        cell = tools.hashed(shared) if shared else np.zeros(len(xs[0]), np.uint64)
        if not numbers:
            return [*xs[::-1], cell]
        # turned coordinates lie between the negative and the positive diagonal
        turned = turn @ np.stack([np.maximum(xs[i], 0.0) for i in numbers])
        return [*xs[::-1], tools.zorder(list((turned + len(numbers)**0.5 + shift[:, None]) / room), 62), cell]

    return keys


def _beside(tools, reach: int, keys, cuts: list[np.ndarray], parts: int):
    """Functions of one turn: rows for the tasks between ``cuts``, and least distance of each synthetic point to the ``reach`` real ones before and after it."""
    d, rows_for = tools.d, _packing(tools)

    def dealt(side: int, types: str):
        def run(batches):
            for _, _, columns in tools.rows_of(batches, types):
                xs, n = [c + 0.0 for c in columns[:d]], len(cuts[0])
                order = np.lexsort([np.concatenate(k) for k in zip(cuts, keys(xs), strict=True)])  # a cut comes before rows like it
                slot = np.empty(len(order), np.int64)
                slot[order] = np.cumsum(order < n)
                if side and types == "d" * d + "q":
                    columns = [*columns, np.full(len(xs[0]), np.inf)]
                yield rows_for(slot[n:], columns, side, parts)

        return run

    def search(batches):
        real, asked = tools.read(batches, "qd")
        if not asked:
            return
        real, asked = (real[1:] if real else [np.zeros(0)] * d), asked[1:]
        n = len(real[0])
        order = np.lexsort(keys([np.concatenate(c) for c in zip(real, asked[:d], strict=True)]))
        known = order[order < n]
        new = tools.firsts([x[known] for x in real])
        place = np.zeros(len(order), np.int64)
        place[order < n] = new
        before = np.cumsum(place)[order >= n]
        real, asked = [x[known[new]] for x in real], [c[order[order >= n] - n] for c in asked]
        first = np.flatnonzero(tools.firsts(asked[:d]))
        xs, weight, best, before = [x[first] for x in asked[:d]], np.add.reduceat(asked[d], first), np.minimum.reduceat(asked[d + 1], first), before[first]
        if n:
            beside = [np.lib.stride_tricks.sliding_window_view(np.pad(x, reach, mode="edge"), 2 * reach) for x in real]
            for a in range(0, len(first), 2048):
                some = [w[before[a:a + 2048]] for w in beside]
                best[a:a + 2048] = np.minimum(best[a:a + 2048], tools.gaps([x[a:a + 2048, None] for x in xs], some, some).min(axis=1))
        for a in range(0, len(first), 100_000):
            columns = [c[a:a + 100_000] for c in (*xs, weight, best)]
            yield pa.RecordBatch.from_arrays([pa.array([len(columns[0])], pa.int32()), pa.array([tools.pack(columns)], pa.binary())], names=["n", "data"])

    return dealt, search


def closest_projected(
    real: DataFrame, synth: DataFrame, cols: list[str], nulls: bool = True, rotations: int = ROTATIONS, reach: int = REACH, seed: int = 7
) -> DataFrame:
    """Like ``closest``, but approximate: distances are those of a near record, mostly the nearest.

    The points of both tables are sorted by what they share (texts, and which
    numbers are null), and within that along a space-filling curve of random projections of their
    numbers; then again with each column left out in turn, as a point's nearest record may
    differ from it in one; and all that ``rotations`` times. Each synthetic point is compared
    with the ``reach`` real ones before and after it. One turn follows the other and leaves the least distances so far, so that
    the disk holds the rows of one turn only; a task holds the points between two cuts that a sample
    on the driver suggests, in any number of columns. Distances are never too small; without real rows they are null.
    """
    known = (lambda df: df) if nulls else (lambda df: df.dropna(subset=cols))
    left, right, kinds, _ = mixed_points(known(real), known(synth), cols)
    d, tools = len(cols), point_tools(kinds)
    held, asked = settled(packed(left, kinds, []), True), settled(packed(right.withColumn("weight", F.lit(1)), kinds, ["weight"]), True)
    step, types = max(1, BLOCK // SEEN), "d" * d + "q"
    seen = [np.ascontiguousarray(x) for x in np.concatenate(_sample([(held, "d" * d), (asked, types)], tools, step)).T]
    size = len(seen[0]) * step
    parts = max(1, min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BESIDE)), size // ALONE))
    rng = np.random.default_rng(seed)
    for out in (out for _ in range(rotations) for out in (None, *range(d))):
        m = sum(not text and i != out for i, text in enumerate(kinds))
        turn, shift = np.linalg.qr(rng.normal(size=(m, m)))[0] if m else np.zeros((0, 0)), rng.random(m)
        keys = _turned(tools, kinds, out, turn, shift)
        marks = keys(seen)
        at = np.lexsort(marks)[len(seen[0]) * np.arange(1, parts) // parts]
        dealt, search = _beside(tools, reach, keys, [k[at] for k in marks], parts)
        rows = held.mapInArrow(dealt(0, "d" * d), _DEALT).unionByName(asked.mapInArrow(dealt(1, types), _DEALT)).repartitionById(parts, "part")
        nearer, types = settled(rows.mapInArrow(search, "n int, data binary"), True), "d" * d + "qd"
        discard(asked)
        asked = nearer
    discard(held)
    found = unpacked(asked, kinds, types, ", ".join([*[f"x{i} double" for i in range(d)], "weight bigint", "distance double"]))
    return found.withColumn("distance", F.when(F.col("distance") < float("inf"), F.sqrt("distance")))


def dcr_summary(distances: DataFrame) -> DataFrame:
    """Weighted mean, smallest distance and share of exact copies."""
    w = F.col("weight")
    return distances.agg(
        F.sum(w).alias("synthetic_rows"),
        (F.sum(w * F.col("distance")) / F.sum(w)).alias("dcr_score"),
        F.min("distance").alias("closest"),
        (F.sum(F.when(F.col("distance") == 0, w).otherwise(0)) / F.sum(w)).alias("copied_share"),
    )


def privacy_report(train: DataFrame, holdout: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Risk level from the mean distance and the share of rows nearer to training than to holdout data."""
    bounds = common_bounds([train, holdout, synth], cols)
    xs = [f"x{i}" for i in range(len(cols))]
    to_train = closest(train, synth, cols, bounds)
    to_holdout = closest(holdout, synth, cols, bounds).select(*xs, F.col("distance").alias("holdout_distance"))
    both = to_train.join(to_holdout, xs)
    w = F.col("weight")
    nearer = F.sum(F.when(F.col("distance") < F.col("holdout_distance"), w).otherwise(0)) / F.sum(w)
    scored = both.agg(
        (F.sum(w * F.col("distance")) / F.sum(w)).alias("dcr_score"), nearer.alias("membership_inference_risk"), F.sum(w).alias("synthetic_rows")
    )
    # half the rows nearer to training data is what chance gives
    excess = F.abs(F.col("membership_inference_risk") - 0.5)
    level = F.when((F.col("dcr_score") < 0.001) | (excess > 0.4), "high").when(
        (F.col("dcr_score") < 0.01) | (excess > 0.2), "medium"
    ).otherwise("low")
    return scored.withColumn("risk_level", level)


def membership_attack(train: DataFrame, holdout: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """How well the distance to the closest synthetic record tells rows of the training data from held-out ones.

    One row: ``members`` and ``others`` (rows of either side), ``auc`` (chance that a member lies
    nearer to the synthetic data than a held-out row, ties counted half), its ``std_error`` after DeLong (null under two rows a side),
    ``advantage`` (largest gap between the shares of members and of others within any one distance) and ``z``, the
    standard errors that ``auc`` lies above one half (null if the error is 0). Without rows on a side, or without synthetic rows, figures are null.

    Columns may be numbers, texts and nulls as in ``closest``. Distances count as equal to nine
    places. The ranks come from running sums over counts by distance, so no side is sorted in one task.
    """
    flagged = train.select(*cols, F.lit(1).alias("_member")).unionByName(holdout.select(*cols, F.lit(0).alias("_member")))
    left, right, kinds, words = mixed_points(synth, flagged, cols, "_member")
    near = _nearest(left, right.withColumn("m", F.col("_member")).withColumn("o", 1 - F.col("_member")), kinds, words, ["m", "o"])
    at = near.groupBy(F.lit(0).alias("all"), F.round("distance", 9).alias("distance")).agg(F.sum("m").alias("m"), F.sum("o").alias("o"))
    ranked = running_totals(at, "all", "distance", ["m", "o"])
    m, o, ms, os = (F.col(c).cast("double") for c in ("m", "o", "all_m", "all_o"))
    # share of the other side that a row of this distance beats
    by_member = F.try_divide(os - F.col("cum_o") + o / 2, os)
    by_other = F.try_divide(F.col("cum_m") - m / 2, ms)
    spread = lambda n, v: F.try_divide(F.sum(n * v * v) - F.try_divide(F.sum(n * v) * F.sum(n * v), F.sum(n)), F.sum(n) - 1)
    error = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(spread(m, by_member), F.sum(m)) + F.try_divide(spread(o, by_other), F.sum(o))))
    known = spread(m, by_member).isNotNull() & spread(o, by_other).isNotNull()
    gap = F.try_divide(F.col("cum_m"), ms) - F.try_divide(F.col("cum_o"), os)
    scored = ranked.agg(
        F.try_divide(F.sum(m * by_member), F.sum(m)).alias("auc"), F.when(known, error).alias("std_error"), F.max(gap).alias("advantage"),
    ).withColumn("z", F.try_divide(F.col("auc") - 0.5, "std_error"))
    sizes = flagged.agg(F.coalesce(F.sum("_member"), F.lit(0)).alias("members"), F.coalesce(F.sum(1 - F.col("_member")), F.lit(0)).alias("others"))
    return sizes.crossJoin(scored)  # one row each
