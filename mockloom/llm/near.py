"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mockloom.llm.batches import give_back, slices
from mockloom.llm.components import components
from mockloom.llm.store import written
from mockloom.llm.words import hashes, lowered, mixed, windows, words
from mockloom.operators.scan import lookup_by_key

#: Hash functions: BANDS keys of ROWS minima each. A pair at similarity 0.8 shares no key once in 300,000.
BANDS, ROWS = 32, 5
#: Low bits kept of every minimum, packed 64 to a word.
BITS = 2
#: Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 5.2
_RANDOM = np.random.default_rng(20_24)
_FACTOR = _RANDOM.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
#: Documents of one bucket that are compared side by side.
BUCKET_BLOCK = 512
#: Hashes of one set taken in one go.
BLOCK = 4096
#: Hashes of the sets that are confirmed together, on each side; a larger set stands alone.
SET_BLOCK = 1 << 19


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer than ``n`` words are one shingle."""
    data = lowered(data)
    begin, end, text = words(data, bounds)
    word = hashes(data, begin, end)
    shingle, of = windows(word, text, n)
    shingle, of = shingle[of >= 0], of[of >= 0]
    count = np.bincount(text, minlength=len(bounds) - 1)
    cut, word_cut = np.searchsorted(of, np.arange(len(bounds))), np.searchsorted(text, np.arange(len(bounds)))
    out = []
    for k, c in enumerate(count.tolist()):
        if c >= n or c == 0:
            out.append(np.unique(shingle[cut[k]:cut[k + 1]]))
        else:
            value = np.array([c], np.uint64)
            for w in word[word_cut[k]:word_cut[k + 1]]:
                value = mixed(value + w)
            out.append(value)
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of a set, and the low bits of its minima, BITS each, packed."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), BLOCK):
        values = _FACTOR[:, None] * shingles[None, k:k + BLOCK] + _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    least = mixed(least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key + row)
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return key.view(np.int64), (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, s1, s2, bands, sig): size of the shingle set, 128 bits that name it, band keys and packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                sets = shingle_sets(data, bounds, n)
                made = [signature(s) if len(s) else (None, None) for s in sets]
                sums = np.array([[s.sum(dtype=np.uint64), mixed(s * _FACTOR[0]).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                columns = [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
                columns += [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "bands", "sig"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>, sig array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: minima whose bits all agree, less those that agree by chance."""
    words_ = BANDS * ROWS * BITS // 64
    fold = int("01" * 32, 2) if BITS == 2 else (1 << 64) - 1

    def unlike(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(fold)) if BITS == 2 else x
        return F.bit_count(x)

    agree = 1 - sum(unlike(k) for k in range(words_)) / F.lit(float(BANDS * ROWS))
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten(), np.int64).reshape(-1, width).view(np.uint64)


def _candidates(percent: int, cut: float):
    """Of two blocks of a bucket: documents of different components that sizes and estimate allow, as lists of partners."""

    def run(rows: pa.Table) -> pa.Table:
        ids, component, n, block = (np.array(rows.column(c), np.int64) for c in ("id", "component", "n", "block"))
        bands, sig = _matrix(rows.column("bands"), BANDS), _matrix(rows.column("sig"), BANDS * ROWS * BITS // 64)
        i, j, key = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), np.array(rows.column("key")[:1], np.int64).view(np.uint64)[0]
        partners: dict[int, list[int]] = {}
        fold = np.uint64(int("01" * 32, 2))
        right = np.flatnonzero(block == j)
        for x in np.flatnonzero(block == i):
            y = right[(component[right] != component[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[ids[y] > ids[x]] if i == j else y
            unlike = sig[y] ^ sig[x]
            unlike = np.bitwise_count((unlike | unlike >> np.uint64(1)) & fold).sum(axis=1)
            y = y[(1 - unlike / (BANDS * ROWS) - 2.0**-BITS) / (1 - 2.0**-BITS) >= cut]
            same = bands[y] == bands[x]
            # a pair belongs to the first band it shares, so that no other bucket takes it again
            y = y[bands[x][same.argmax(axis=1)] == key] if len(y) else y
            if len(y):
                partners[int(x)] = ids[y].tolist()
                for k in y.tolist():
                    partners.setdefault(k, [])
        # members with partners, in blocks of SET_BLOCK hashes; two blocks at a time are confirmed
        taken = sorted(partners)
        part = dict(zip(taken, _parts(n[taken]).tolist(), strict=True))
        at = {int(d): k for k, d in enumerate(ids) if k in part}
        rows_: dict[tuple[int, int, int], list[int]] = {}
        for x, others in partners.items():
            for other in others:
                y = at[other]
                rows_.setdefault((part[x], part[y], x), []).append(other)
                rows_.setdefault((part[x], part[y], y), [])
        group = [pa.array([rows.column(c)[0].as_py()] * len(rows_), rows.column(c).type) for c in ("key", "i", "j")]
        halves = [pa.array([r[k] for r in rows_], pa.int32()) for k in (0, 1)]
        columns = [pa.array([ids[r[2]] for r in rows_], pa.int64()), pa.array(list(rows_.values()), pa.list_(pa.int64()))]
        return pa.Table.from_arrays(group + halves + columns, names=["key", "i", "j", "p", "q", "id", "partners"])

    return run


def _parts(n: np.ndarray) -> np.ndarray:
    """Number of each set's block: sets in turn up to SET_BLOCK hashes."""
    out, number, held = np.zeros(len(n), np.int64), 0, 0
    for k, size in enumerate(n.tolist()):
        if held and held + size > SET_BLOCK:
            number, held = number + 1, 0
        out[k], held = number, held + size
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def _links(percent: int):
    """Partners in a group whose whole sets are similar enough."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
        at, found = {d: k for k, d in enumerate(ids)}, []
        for x, others in enumerate(rows.column("partners").to_pylist()):
            for other in others:
                y = at[other]
                both = _shared(sets[x], sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    found.append((ids[x], other))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, cut: float) -> DataFrame:
    """Links (a, b) between components, of all buckets that hold several.

    ``members`` is (key, id, component). A bucket is cut in blocks of about
    BUCKET_BLOCK; two blocks at a time are compared by signature, and the lists
    of possible partners are confirmed on the whole sets, of SET_BLOCK hashes on
    each side at a time. No pair becomes a row but a link, and no group holds more than two blocks.
    """
    stats = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = written(stats.where("low < high").select("key", F.ceil(F.col("c") / BUCKET_BLOCK).cast("int").alias("blocks")), "near-several")
    rows = members.join(several, "key").join(classes.select("id", "n", "bands", "sig"), "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    maybe = rows.groupBy("key", "i", "j").applyInArrow(_candidates(percent, cut), "key long, i int, j int, p int, q int, id long, partners array<long>")
    return written(maybe, "near-partners").join(sets, "id").groupBy("key", "i", "j", "p", "q").applyInArrow(_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    sets of ``n``-word shingles (A-Z lowered); ``component_id`` is the smallest id
    reachable and ``kept`` marks that document.

    1. One pass makes band keys and 2-bit signatures. Equal sets are one class
       from here on, so copies are never paired.
    2. Members of a bucket (equal band key) are paired with its smallest member.
       Every document is first linked to the partner with the best estimate.
       Only documents of one bucket and different components are compared again,
       in blocks (see ``_across``): the components of a large group of near copies
       are few by then, and no candidate pair is left out.
    3. Estimates rule out pairs SLACK deviations under the threshold; all others
       are confirmed on the whole sets, which are made for bucket members only.

    Empty and null texts have no shingles and are linked with nothing. Rows with a
    null id are compared with nothing: component null, kept. Rows that repeat an
    id are linked if their texts are. An empty table gives no rows. Very long texts are read whole.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = written(signatures(source, n), "near-signatures")
    named = signed.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "near-classes")
    keyed = classes.select(F.explode("bands").alias("key"), "id")
    buckets = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    members = written(lookup_by_key(keyed, buckets, ["key"]).select("key", "id", "hub"), "near-members")

    wanted = members.select(F.col("id").alias("doc_id")).distinct()

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(data, bounds, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), sets], names=["id", "shingles"])
        give_back()

    sets = written(source.join(wanted, "doc_id", "left_semi").mapInArrow(set_rows, "id long, shingles binary"), "near-sets")

    t = percent / 100
    cut = t - SLACK * ((t + (1 - t) * 2.0**-BITS) * (1 - t) / (BANDS * ROWS) / (1 - 2.0**-BITS)) ** 0.5
    stars = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    for x in "ab":
        stars = stars.join(classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")), x)
    stars = stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).withColumn("est", estimate(F.col("sa"), F.col("sb"))).where(F.col("est") >= cut)
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b")
    linked = components(written(_confirmed(nearest, sets, percent), "near-links"))
    held = members.select("key", "id").join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    held = written(held, "near-held")
    linked = components(linked.select("id", "component").union(_across(held, classes, sets, percent, cut)))
    of_class = classes.select("n", "s1", "s2", "id").join(linked, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are; of kept rows that share an id and a text, one.

    Rows that share an id but not a text all stay, as do rows with a null id. Null and empty texts are the same text.
    """
    kept = near_duplicates(docs, n, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    held = docs.select(docs[id_col].cast("long").alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    same = F.sha2(F.coalesce(F.col("doc")[text_col], F.lit("")), 256).alias("_text")
    one = held.join(kept, "_id", "left_semi").groupBy("_id", same).agg(F.min_by("doc", F.coalesce(F.col("doc")[text_col], F.lit(""))).alias("doc"))
    return one.select("doc.*").union(held.where("_id is null").select("doc.*"))
