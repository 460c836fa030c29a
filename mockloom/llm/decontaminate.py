"""Documents that hold a benchmark item, up to a share of edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed: one for so many characters of an item.
PER_EDIT = 12
#: Items shorter than this are only found without edits.
EXACT_BELOW = 40
#: Characters of benchmark text searched for in one pass over the documents.
BLOCK_CHARS = 2_000_000


def normal(text: bytes) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.decode().lower().split())


class Item(NamedTuple):
    item_id: int | None
    text: str
    budget: int
    #: Positions of each character as bits, for the distance.
    bits: dict[str, int]


def as_item(item_id: int | None, text: str) -> Item:
    bits: dict[str, int] = {}
    for k, c in enumerate(text):
        bits[c] = bits.get(c, 0) | 1 << k
    return Item(item_id, text, len(text) // PER_EDIT if len(text) >= EXACT_BELOW else 0, bits)


def distance(item: Item, text: str) -> int:
    """Least edit distance of the item to any stretch of ``text`` (Myers: a column of differences in two machine words of any length)."""
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    get = item.bits.get
    for c in text:
        eq = get(c, 0)
        x = eq | down
        zero = ((up & eq) + up ^ up) | x
        more, less = down | ~(zero | up) & full, up & zero
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best = score
        more, less = more << 1, less << 1
        up = (less | ~(zero | more)) & full
        down = more & zero
    return best


class Finder:
    """All items of a block in one automaton over their pieces."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            n = item.budget + 1
            cuts = [len(item.text) * k // n for k in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(item.text[a:b], []).append((i, b))
        for piece, where in places.items():
            self.pieces.add_word(piece, where)
        self.pieces.make_automaton()

    def __call__(self, text: str) -> dict[int, int]:
        """Items found in a text: {number: distance}.

        With at most k edits one of k + 1 pieces stays whole, so every match shows
        as a piece hit; the item is then compared with the text around it.
        """
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        if not self.items:
            return found
        for end, where in self.pieces.iter(text):
            for i, b in where:
                if found.get(i) == 0:
                    continue
                begin = end + 1 - b
                item = self.items[i]
                step = item.budget + 1
                # hits of one item whose places differ by edits only are compared once, with room on both sides
                if (i, begin // step) in seen:
                    continue
                seen.add((i, begin // step))
                low = begin // step * step - item.budget
                high = low + 2 * item.budget + step + len(item.text) + item.budget
                if text.startswith(item.text, begin) and begin >= 0:
                    found[i] = 0
                    continue
                d = distance(item, text[max(0, low):high])
                if d <= item.budget and d < found.get(i, d + 1):
                    found[i] = d
        return found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items in blocks of about BLOCK_CHARS, collected one block at a time."""
    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].alias("text")).where("text is not null").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        texts = [(r.item_id, normal(r.text.encode())) for r in block]
        yield [as_item(i, t) for i, t in texts if t]


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _search(block: list[Item]) -> Callable[[], Finder]:
    plain = [(i.item_id, i.text) for i in block]
    return lambda: Finder([as_item(*x) for x in plain])


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) for every document that holds an item with at most one edit in PER_EDIT characters.

    Both sides are normalised (lower case, white space as one space). The benchmark
    is the query set: it goes to all tasks in blocks of bounded text, one pass over
    all documents for each block, without a shuffle; whole texts are searched.

    Null and empty texts on either side match nothing; short items (under
    EXACT_BELOW) only match without edits. Equal items are searched once for each id.
    Repeated documents give their rows again; null ids stay null. Empty tables give no rows.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text):
        finder = _search(block)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            find = finder()
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += [(doc, find.items[i].item_id, d) for i, d in find(normal(_raw(text))).items()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance"])

        found = source.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are; see ``matches``."""
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_id, item_text):
        finder = _search(block)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            find = finder()
            for batch in batches:
                yield batch.filter(pa.array([not find(normal(_raw(text))) for text in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
