"""Merkle manifest of a table: a tree for each group of rows, one over all groups, and a witness for every row.

Leaves are appended in order to blocks of 3**HEIGHT, which are whole subtrees. A
block keeps its open runs; whoever lies below a node of a run gets the run's
other nodes added to its witness when the run is complete. The roots of blocks
are appended in the same way, block by block of blocks, until each group has one
root, and the roots of the groups are appended last. A witness made in one round
is extended by that of its block in the next, so no round holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mockloom.llm.store import written
from mockloom.operators.scan import dense_index

#: Nodes of a run, and levels of runs in a block.
FAN, HEIGHT = 3, 6
BLOCK = FAN**HEIGHT
#: Rows put out at once.
ROWS_OUT = 4096


class Block:
    """Open subtrees of one block: leaves are appended, complete runs extend the witnesses below them."""

    def __init__(self) -> None:
        #: For each leaf, the nodes before and after it in its run, level by level, each side joined.
        self.witness: list[list[tuple[str, str]]] = []
        #: For each level the nodes of its open run: (digest, first leaf below, one past the last).
        self.open: list[list[tuple[str, int, int]]] = [[]]

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [digest for digest, _, _ in run]
        for k, (_, first, last) in enumerate(run):
            others = "".join(names[:k]), "".join(names[k + 1:])
            for leaf in range(first, last):
                self.witness[leaf].append(others)
        self._add(level + 1, (sha256("".join(names).encode()).hexdigest(), run[0][1], run[-1][2]))

    def close(self, height: int | None) -> str:
        """Complete the open runs, up to ``height`` levels or until one node remains, and return that node."""
        level = 0
        while level != height if height else len(self.open[level]) != 1 or any(self.open[level + 1:]):
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


_WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def _witnesses(lists: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = [0]
    for w in lists:
        offsets.append(offsets[-1] + len(w))
    sides = [pa.array([pair[k] for w in lists for pair in w], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, names=["left", "right"]))


def _appended(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, pos, n, node and others) with ``block``, the witness inside it and the block's ``top``.

    A partition holds whole blocks in order and streams through them. The blocks
    of a key with several are raised to full height.
    """
    placed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    placed = placed.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    schema = T.StructType([*placed.schema.fields, T.StructField("witness", _WITNESS), T.StructField("top", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        lists: list[list[tuple[str, str]]] = []
        tops: list[str] = []
        here, block, several = None, Block(), False

        def finish() -> None:
            if block.witness:
                tops.extend([block.close(HEIGHT if several else None)] * len(block.witness))
                lists.extend(block.witness)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, lists, tops
            if lists:
                rows = pa.Table.from_batches(held)
                held = rows.slice(len(lists)).to_batches()
                rows = rows.slice(0, len(lists)).append_column("witness", _witnesses(lists)).append_column("top", pa.array(tops, pa.string()))
                lists, tops = [], []
                yield from rows.to_batches()

        for batch in batches:
            held.append(batch)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "block", "n", "node")]
            for key, number, n, node in zip(*columns, strict=True):
                if (key, number) != here:
                    finish()
                    here, block, several = (key, number), Block(), n > BLOCK
                block.append(node)
            if len(lists) >= ROWS_OUT:
                yield from out()
        finish()
        yield from out()

    return placed.mapInArrow(run, schema)


def tree(nodes: DataFrame, name: str = "manifest") -> DataFrame:
    """``nodes`` with ``witness`` up to the root of their key, and that ``top``.

    ``nodes`` has ``key`` (not null), ``pos`` (gapless from 0 in each key), ``n`` (nodes of the key) and ``node``.
    """
    grown = written(_appended(nodes), name)
    above = grown.where((F.col("n") > BLOCK) & (F.col("pos") % BLOCK == 0))
    if above.isEmpty():
        return grown.drop("block")
    above = tree(above.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("node")), name)
    above = above.select("key", F.col("pos").alias("block"), F.col("witness").alias("_more"), F.col("top").alias("_top"))
    joined = grown.join(above, ["key", "block"], "left")
    more = F.coalesce("_more", F.array().cast(_WITNESS))
    return joined.select(*[c for c in nodes.columns], F.concat("witness", more).alias("witness"), F.coalesce("_top", "top").alias("top"))


def digest(*columns: Column) -> Column:
    """SHA-256 of the values in turn: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """Root that a leaf and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, others: F.sha2(F.concat(others["left"], node, others["right"]), 256))


def proof(witness: Column) -> Column:
    """The siblings of a witness, level by level and left to right, as one text."""
    return F.aggregate(witness, F.lit(""), lambda text, others: F.concat(text, others["left"], others["right"]))


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf") -> DataFrame:
    """(leaf, subroot, root, witness, row) of every row of ``leaves``; ``row`` is the whole input row.

    Leaves of a group ascend by id (nulls first; repeated ids by digest). While a
    group has several nodes, every FAN of them in a row, of the last run fewer,
    become the SHA-256 of their joined digests. The last node is the ``subroot``; subroots in
    the order of their groups (null first, then by UTF-8 bytes) are joined to the
    ``root`` likewise. ``witness`` lists for each level the siblings on the left and on the right.

    Texts are not shuffled: only digests are range-sorted, whose place gives the
    positions, however large a group is. Each round of blocks is a written table.
    Null ids and groups are values like any other; an empty table gives no rows;
    the input's other columns, of any name, come back in ``row``.
    """
    whole = F.struct(*[leaves[c] for c in leaves.columns])
    key = F.coalesce(F.concat(F.lit("1"), leaves[group_col]), F.lit("0"))
    rows = written(leaves.select(key.alias("key"), leaves[id_col].alias("id"), leaves[leaf_col].alias("node"), whole.alias("row")), "manifest-leaves")
    # the layout has to stay as it is from here on: positions rest on it
    placed = written(rows.orderBy("key", "id", "node").withColumn("at", F.monotonically_increasing_id()), "manifest-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    # rows of a key in this window are at most as many as the partitions of the sort
    of_key = Window.partitionBy("key")
    before = F.sum("here").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select("key", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(of_key).alias("n"))
    nodes = placed.join(parts, ["key", "part"]).select("key", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "node", "row")
    grown = tree(nodes)
    subroots = written(grown.where("pos = 0").select("key", "top"), "manifest-subroots")
    groups = subroots.count()
    ordered = dense_index(subroots, ["key"], "pos").select(F.lit("").alias("key"), "pos", F.lit(groups).cast("long").alias("n"), F.col("top").alias("node"), F.col("key").alias("group"))
    tops = tree(ordered, "manifest-tops").select(F.col("group").alias("key"), F.col("top").alias("root"), F.col("witness").alias("_more"))
    return grown.join(tops, "key").select(
        F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("witness", "_more").alias("witness"), "row")
