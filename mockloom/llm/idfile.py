"""Token ids of documents in a compressed file: canonical Huffman codes of limited length, in independent blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mockloom.llm.batches import give_back, slices
from mockloom.llm.pieces import library
from mockloom.llm.store import written
from mockloom.llm.tokens import tokenizer_file

#: Longest code. Tables of 2**LIMIT entries decode a symbol with one lookup.
LIMIT = 16
#: Ids between two checkpoints, and ids after which a block ends.
STRETCH, BLOCK_IDS = 256, 1 << 18

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code with none above ``limit`` (package-merge). Counts are positive."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)  # whether each of the level's items is a symbol
        merged = merged[place]
        packages = merged[0:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbol in reversed(levels):  # the first `take` items of a level: its lightest symbols, and packages of the level below
        symbols = int(symbol[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code(NamedTuple):
    """Canonical code: lengths by id, and codes in order of (length, id)."""

    length: np.ndarray
    code: np.ndarray
    #: By the next LIMIT bits: the symbol, and its length.
    symbol: np.ndarray
    size: np.ndarray


def canonical(ids: np.ndarray, lengths: np.ndarray) -> Code:
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    step = np.int64(1) << (LIMIT - lengths)
    until = np.cumsum(step)
    top = int(ids.max()) + 1 if len(ids) else 0
    length, code = np.zeros(top, np.int64), np.zeros(top, np.uint64)
    length[ids], code[ids] = lengths, ((until - step) >> (LIMIT - lengths)).astype(np.uint64)
    symbol, size = np.zeros(1 << LIMIT, np.int32), np.ones(1 << LIMIT, np.int64)
    total = int(until[-1]) if len(until) else 0
    symbol[:total], size[:total] = np.repeat(ids, step), np.repeat(lengths, step)
    return Code(length, code, symbol, size)


def pack(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """Bits of all ids, and the bit offset of every STRETCH-th."""
    length = code.length[ids]
    until = np.cumsum(length)
    at = until - length
    word, inside = at >> 5, (at & 31).astype(np.uint64)
    value = code.code[ids] << (np.uint64(64) - length.astype(np.uint64) - inside)
    total = int(until[-1]) if len(until) else 0
    n = (total >> 5) + 2
    # bits of different codes never meet, so sums of a word's parts are exact and carry nothing
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[:(total + 7) // 8], at[::STRETCH]


def unpack(bits: bytes, offsets: np.ndarray, sizes: np.ndarray, code: Code) -> np.ndarray:
    """Ids of a block: stretches at ``offsets`` of ``sizes`` ids, all side by side, one symbol of each a step."""
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.zeros(int(sizes.sum()), np.int32)
    order = np.argsort(-sizes, kind="stable")
    at, to = offsets[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for k, n in enumerate(live.tolist()):
        place = at[:n]
        next_ = window[place >> 3] << (place & 7).astype(np.uint32) >> np.uint32(32 - LIMIT)
        out[to[:n] + k] = code.symbol[next_]
        place += code.size[next_]
    return out


def stretches(sizes: np.ndarray) -> np.ndarray:
    """Ids of each stretch of documents of ``sizes`` ids: STRETCH, and what is left at a document's end."""
    parts = -(-sizes // STRETCH)
    out = np.full(int(parts.sum()), STRETCH, np.int64)
    out[np.cumsum(parts)[sizes > 0] - 1] = (sizes - (parts - 1) * STRETCH)[sizes > 0]
    return out


def width(tokenizer: str, end_id: int | None) -> str:
    """Integers of two bytes if all ids fit, of four otherwise."""
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer_file(tokenizer)).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    return "<u2" if top <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, kind: str) -> DataFrame:
    """(doc_id, ids) of each row: ids as little-endian unsigned integers, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(tokenizer_file(tokenizer)).ids
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                ids, count = encode(data, bounds)
                if end_id is not None:
                    ids, count = np.insert(ids, np.cumsum(count), end_id), count + 1
                raw = ids.astype(kind)
                cuts = np.append(0, np.cumsum(count)).tolist()
                binary = pa.array([raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), binary], names=["doc_id", "ids"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _counts(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs. Tasks add up before they shuffle; rows are at most the vocabulary's size for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                found = np.bincount(np.frombuffer(raw.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), np.int64))
                total[:len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all rows, in ascending order of document id, to ``path``.

    ``path/codebook`` holds (id, length) of the canonical code, ``path/blocks`` the
    blocks: (part, block) is a block's place in the file, ``doc_ids`` and ``sizes`` name its
    documents and their numbers of ids, ``starts`` counts the ids of the part before each,
    ``bits`` are the codes and ``offsets`` the bit offset of every STRETCH-th id of
    each document. Documents begin at whole bytes. A block is read without any other.

    Documents are tokenized once, by the tokenizers library, into a table in the
    shared folder; code lengths come from the counts of all ids, at most one row
    for each id of the vocabulary. Only coded documents are shuffled, by a range
    sort on the document id; running totals over parts give the starts.

    Null and empty texts hold the end id only. Equal document ids stay together, ordered by
    their codes; null ids come first. An empty table gives an empty codebook and no blocks.
    """
    spark, kind = docs.sparkSession, width(tokenizer, end_id)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = written(tokenized(source, tokenizer, end_id, kind), "ids-tokens", compression="zstd")
    found = _counts(rows, kind).collect()  # at most the vocabulary
    known = np.array([r.id for r in found], np.int64)
    lengths = code_lengths(np.array([r.n for r in found], np.int64)) if found else known
    book = spark.createDataFrame([(int(i), int(n)) for i, n in zip(known, lengths, strict=True)], "id long, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = canonical(known, lengths)
        for batch in batches:
            sizes, offsets, bits = [], [], []
            for raw in batch.column(1):
                ids = np.frombuffer(raw.as_buffer(), kind)
                packed, places = pack(ids, code)
                sizes.append(len(ids))
                offsets.append(places)
                bits.append(packed)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(offsets, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "offsets", "bits"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, start, held, total = 0, 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, start
            parts, docs_, sizes, offsets, bits = zip(*held, strict=True)
            sizes = np.array(sizes, np.int64)
            base = np.cumsum([0, *map(len, bits)]) * 8
            places = np.concatenate([np.array(o, np.int64) + b for o, b in zip(offsets, base, strict=False)])
            values = (parts[0], number, docs_, start + np.cumsum(sizes) - sizes, sizes, places, b"".join(bits))
            number, start = number + 1, start + int(sizes.sum())
            kinds = (pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "block", "doc_ids", "starts", "sizes", "offsets", "bits"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                total += row[2]
                if total >= BLOCK_IDS:
                    yield block()
                    held, total = [], 0
        if held:
            yield block()
        give_back()

    shape = "part int, block long, doc_ids array<long>, starts array<long>, sizes array<long>, offsets array<long>, bits binary"
    coded = rows.mapInArrow(encode, "doc_id long, n long, offsets array<long>, bits binary")
    ordered = coded.orderBy("doc_id", "n", F.xxhash64("bits")).select(F.spark_partition_id().alias("part"), "doc_id", "n", "offsets", "bits")
    ordered.mapInArrow(assemble, shape).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a file that ``write_ids`` wrote, ids as little-endian unsigned 32-bit integers."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    known, lengths = np.array([r.id for r in book], np.int64), np.array([r.length for r in book], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row for each part

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = canonical(known, lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                before, docs, starts, sizes, offsets, bits = (c[k] for c in batch.columns)
                sizes, starts = (np.array(x.values, np.int64) for x in (sizes, starts))
                ids = unpack(bits.as_buffer().to_pybytes(), np.array(offsets.values, np.int64), stretches(sizes), code).astype("<u4")
                cuts = np.append(0, np.cumsum(sizes)).tolist()
                raw = [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(starts + before.as_py()), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])
        give_back()

    placed = blocks.join(F.broadcast(parts), "part").select("before", "doc_ids", "starts", "sizes", "offsets", "bits")
    return placed.mapInArrow(decode, "doc_id long, start long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded documents."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
