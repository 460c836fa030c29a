import zlib
from collections import Counter, defaultdict

import pytest

from mockloom.llm import shards


def least_capacity(sizes, n):
    def need(most):
        count, held = 1, 0
        for s in sizes:
            if held + s > most:
                count, held = count + 1, 0
            held += s
        return count

    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(middle) <= n else (middle + 1, high)
    return low


def check(docs, n=8):
    got = shards.shard(docs, n).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
    slots, size, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(n))
    group, first = Counter(), {}
    for d, t in sorted(texts):
        group[t] += len(t.encode()) + 1
        first.setdefault(t, d)
    assert max(size.values()) == least_capacity([group[t] for t in sorted(group, key=first.get)], n)
    return size


def test_tables(documents, edges, nothing):
    size = check(documents)
    assert len(size) == 8 and min(size.values()) > 0.8 * max(size.values())
    check(edges, 3)
    assert shards.shard(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_hot_group(spark, n):
    docs = [(i, "same text in a third of all rows" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(300)]
    size = check(spark.createDataFrame(docs, "doc_id long, text string"), n)
    assert len(size) == n


def test_fewer_groups_than_shards(spark):
    check(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "doc_id long, text string"), 8)
