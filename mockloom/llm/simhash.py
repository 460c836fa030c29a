"""Near-duplicate documents by SimHash fingerprints, found by balls that meet in the middle.

Two fingerprints at distance 2k share a variant at distance k of both, so each
emits its ball of radius k and equal variants are looked for by a shuffle. For
an odd radius 2k + 1 the half is no whole number of bits. A ball of radius k + 1
would have 2,081 variants at radius 3, twelve times the size of the documents. So
the bits are cut in GROUPS groups, and balls of radius k are made four times, each
time with one group left out: of 2k + 1 differing bits at least one lies in some
group, and without that group 2k or fewer are left. That makes 196 variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.llm.batches import slices
from mockloom.llm.components import components
from mockloom.llm.store import written
from mockloom.operators.scan import lookup_by_key

SEED = 42
#: Groups of bits, one of which is left out where the radius is odd; 64 / GROUPS bits each.
GROUPS = 4
#: Shingles hashed in one go, and fingerprints whose balls are made in one go.
SHINGLES, BALLS = 1 << 15, 1 << 9
#: Members of a bucket compared side by side; larger buckets are cut in blocks.
BUCKET_BLOCK = 64


def fingerprint(text: bytes, n: int) -> int:
    """64 bits, each set if it is set in over half of the hashes of the ``n``-word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    total, ones, digest = len(words) - n + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, total, SHINGLES):
        part = [words[start + k:min(start + SHINGLES, total) + k] for k in range(n)]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*part, strict=True)), np.uint64, len(part[0]))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, print) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                raw = data.tobytes()
                made = np.array([fingerprint(raw[a:b], n) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return docs.mapInArrow(run, "doc_id long, print long")


def ball(prints: np.ndarray, radius: int) -> np.ndarray:
    """Variants of each fingerprint within half of ``radius``: those of two fingerprints meet if they differ in ``radius`` bits or fewer."""
    if radius % 2 == 0:
        width, bases = 64, prints[:, None]
    else:
        step = 64 // GROUPS
        width, parts = 64 - step, []
        for g in range(GROUPS):
            low = prints & np.uint64((1 << g * step) - 1)
            high = prints >> np.uint64(g * step) >> np.uint64(step) << np.uint64(g * step)
            parts.append(low | high | np.uint64(g << width))
        bases = np.stack(parts, axis=1)
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(width), k)]
    return (bases[:, :, None] ^ np.array(flips, np.uint64)).reshape(len(prints), -1)


def _variants(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            for start in range(0, len(prints), BALLS):
                part = prints[start:start + BALLS]
                keys = ball(part, radius)
                columns = [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "print"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, hub) of keys with several rows, from rows sorted by key; ``hub`` is the key's first print."""
    # the last row so far: its key, print and hub, and whether it was put out
    last_key, last_print, last_hub, out = 0, 0, 0, True
    none = True
    for batch in batches:
        key, print_ = (np.asarray(c) for c in batch.columns)
        if not len(key):
            continue
        goes_on = not none and key[0] == last_key
        if goes_on and not out:
            key, print_ = np.append(last_key, key), np.append(last_print, print_)
        first = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(key)))
        hub = print_[start]
        shown = size > 1
        if goes_on:
            hub[0], shown[0] = last_hub, True
        keep, hubs = np.repeat(shown, size), np.repeat(hub, size)
        none, last_key, last_print, last_hub, out = False, key[-1], print_[-1], hubs[-1], bool(shown[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, print_, hubs)], names=["key", "print", "hub"])


def _close(radius: int):
    """Components that have members within the radius of each other, in runs of rows of equal (key, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [np.asarray(c) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rows[:3]], axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            held = [c[cut:] for c in rows]
            yield _pairs([c[:cut] for c in rows], radius)
        if held is not None:
            yield _pairs(held, radius)

    return run


def _pairs(rows: list[np.ndarray], radius: int) -> pa.RecordBatch:
    key, i, j, print_, component = rows
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, len(key)):
        same = np.flatnonzero((key[d:] == key[:-d]) & (i[d:] == i[:-d]) & (j[d:] == j[:-d]))
        if not len(same):  # rows of a group stand together, so no larger distance has any
            break
        a, b = same, same + d
        near = (component[a] != component[b]) & (np.bitwise_count((print_[a] ^ print_[b]).view(np.uint64)) <= radius)
        pairs = np.stack([component[a[near]], component[b[near]]], axis=1)
        found.append(np.unique(np.sort(pairs, axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _across(members: DataFrame, linked: DataFrame, radius: int) -> DataFrame:
    """(u, v): components of which a bucket holds members within ``radius`` of each other.

    A bucket of more than BUCKET_BLOCK members is cut in blocks of about half as
    many, and two blocks at a time are compared.
    """
    held = members.select("key", "print").join(linked.withColumnRenamed("id", "print"), "print", "left")
    held = written(held.select("key", "print", F.coalesce("component", "print").alias("component")), "simhash-held")
    several = held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.when(F.col("c") <= BUCKET_BLOCK, 1).otherwise(F.ceil(F.col("c") / (BUCKET_BLOCK // 2)))
    rows = held.join(several.select("key", blocks.cast("int").alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print", "component")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_close(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every row.

    Documents are linked when their fingerprints differ in ``radius`` bits or
    fewer; ``component_id`` is the smallest id reachable and ``kept`` marks that document.

    1. One pass over the texts makes the fingerprints (A-Z lowered, ``n``-word shingles joined by a space, XXH64).
       Equal fingerprints are one class from here on, so copies are never paired.
    2. Every class emits its ball of variants (see the module). One shuffle on the
       variants, sorted, shows those met by several classes; single ones go no further.
    3. Each class is tied to the smallest first member of its buckets that is near enough.
    4. Buckets whose members still lie in several components are compared within
       themselves, in blocks. What a bucket gives are pairs of components, so a large
       group of near copies costs no row for each of its pairs, and no link is left out.

    Texts without words have the fingerprint zero and are linked like any other.
    Rows with a null id have a fingerprint, are linked with nothing and kept: component
    null. Rows that repeat an id are linked where their fingerprints are near.
    An empty table gives no rows. Very long texts are read whole.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = written(fingerprints(source, n), "simhash-prints")
    classes = signed.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"))
    # a given number of partitions, as Spark would merge these small rows into few before they grow
    spread = classes.select("print").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    variants = spread.mapInArrow(_variants(radius), "key long, print long")
    members = written(variants.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_met, "key long, print long, hub long"), "simhash-members")
    near = (F.col("print") != F.col("hub")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) <= radius)
    linked = components(members.where(near).groupBy("print").agg(F.min("hub").alias("hub")).select("hub", "print"))
    linked = components(linked.select("id", "component").union(_across(members, linked, radius)))
    of_class = written(classes.join(linked.withColumnRenamed("id", "print"), "print", "left").select("print", "id", F.coalesce("component", "print").alias("component")), "simhash-classes")
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    named = lookup_by_key(of_class.select("print", "component"), least, ["component"]).select("print", "component_id")
    rows = lookup_by_key(signed.where("doc_id is not null"), named, ["print"]).select("doc_id", "print", "component_id")
    rows = rows.union(signed.where("doc_id is null").select("doc_id", "print", F.lit(None).cast("long")))
    fingerprint_ = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return rows.select("doc_id", fingerprint_, "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
