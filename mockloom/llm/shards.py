"""Documents in shards of near equal bytes, equal texts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mockloom.llm.store import written

#: Capacities tried in one pass over the group sizes.
TRIES = 32


def _placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """Sorted rows, written, with ``_part`` (rising with the order) and ``_at`` (rising within a part)."""
    at = F.monotonically_increasing_id()
    return written(df.orderBy(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), name)


def _before(df: DataFrame, size) -> DataFrame:
    """(_part, _off): what all earlier parts hold. One row for each part."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("_part").agg(size.alias("_size"))
    return parts.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off"))


def _reach(ends: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the last group end that is not above it, 0 if none is. A group is no longer than ``largest``."""
    near = ends.where(F.col("upto").between(min(limits) - largest, max(limits)))
    found = near.agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"_{k}") for k, x in enumerate(limits)]).first()
    return [v or 0 for v in found]


def cuts(ends: DataFrame, shards: int) -> list[int]:
    """Shard ends that make the largest of ``shards`` contiguous parts as small as it can be.

    ``ends`` has ``upto``, the running size at the end of each group, written in
    that order. The smallest feasible capacity is searched between the larger of
    mean shard and largest group, and mean plus largest, which always suffices.
    Greedy filling needs one lookup for each shard; a pass makes it for TRIES
    capacities at once, and narrows the range to one of their gaps. The driver
    holds numbers of shards and tries only. Under the capacity found, each cut
    goes as near to an even share of what is left as later shards allow.
    """
    total, largest = ends.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return [0] * shards
    mean = -(-total // shards)
    low, high = max(mean, largest), mean + largest
    while low < high:
        gap = max(1, -(-(high - low) // TRIES))
        tries = list(range(low, high, gap))
        at = [0] * len(tries)
        for _ in range(shards):
            if min(at) < total:
                at = _reach(ends, [a + c for a, c in zip(at, tries, strict=True)], largest)
        good = next((k for k, a in enumerate(at) if a >= total), len(tries))
        high = tries[good] if good < len(tries) else high
        low = high if good == 0 else tries[good - 1] + 1
    least = [total]
    for _ in range(shards - 1):  # from behind: where a shard may end so that the rest still fits
        need = least[0] - high
        least.insert(0, 0 if need <= 0 else ends.where(F.col("upto").between(need, need + largest)).agg(F.min("upto")).first()[0])
    out, at = [], 0
    for k in range(shards):
        even = at + (total - at) // (shards - k)
        below, top = _reach(ends, [max(even, least[k]), at + high], largest)
        above = ends.where((F.col("upto") > even) & (F.col("upto") <= top)).agg(F.min("upto")).first()[0]
        below = max(below, at)
        at = below if below >= least[k] and (above is None or even - below <= above - even) else above if above is not None else below
        at = min(max(at, least[k]), top) if k < shards - 1 else total
        out.append(at)
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) under the law ``bytes``.

    Groups are equal texts, ordered by their smallest id; a group is never cut, so
    one larger than a mean shard sets the capacity. Running sizes come from range
    sorts whose parts are written once; copies of one text spread over parts, as the
    sort goes on by id.

    Size is UTF-8 bytes plus 1; a null text counts as empty, of the same group as
    empty texts. Repeated rows and ids get slots of their own. An empty table gives
    no rows. Texts are hashed (SHA-256) and not shuffled.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    light = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"))
    light = written(light, "shard-rows")
    groups = light.groupBy("group").agg(F.min("doc_id").alias("lead"), F.sum("size").alias("bytes"))
    order = [F.col("lead").asc_nulls_last(), "group"]
    sorted_groups = _placed(groups, order, "shard-groups")
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = sorted_groups.withColumn("_in", F.sum("bytes").over(within)).join(F.broadcast(_before(sorted_groups, F.sum("bytes"))), "_part")
    ends = written(ends.select("group", "lead", "bytes", (F.col("_in") + F.col("_off")).alias("upto")).sortWithinPartitions("upto"), "shard-ends")
    number = sum((F.col("upto") > c).cast("int") for c in cuts(ends, shards)[:-1]) if shards > 1 else F.lit(0)
    rows = light.join(ends.select("group", "lead", number.alias("shard")), "group")
    placed = _placed(rows, [*order, F.col("doc_id").asc_nulls_last()], "shard-placed")
    base = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = placed.join(F.broadcast(_before(placed, F.count(F.lit(1)))), "_part").join(F.broadcast(base), "shard")
    slot = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off") - F.col("_base")
    return out.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
