"""Order of tables by peeling."""

import random

import pytest

from mockloom.operators import generate
from mockloom.operators.levels import levels


def ordered(spark, docs, strict=False):
    nodes = [(d, t) for d, tables in docs.items() for t in tables]
    edges = sorted({(d, c, p) for d, tables in docs.items() for c, parents in tables.items() for p in parents})
    got = levels(spark.createDataFrame(nodes, "doc string, name string"), spark.createDataFrame(edges, "doc string, child string, parent string"), strict).collect()
    assert len(got) == len(nodes)
    return {(r["doc"], r["name"]): r["level"] for r in got}


def plain(tables):
    """The same by sets: place what has no parent left, else the smallest of each cycle that nothing leads into."""
    left, level = set(tables), {}
    while left:
        ready = {t for t in left if not (set(tables[t]) & left)} or generate._cycle_heads(left, {t: set(p) for t, p in tables.items()})
        for t in ready:
            level[t] = max((level[p] + 1 for p in tables[t] if p in level), default=0)
        left -= ready
    return level


def test_against_sets(spark):
    docs = {}
    for seed in range(12):
        r = random.Random(seed)
        names = [f"t{k:02}" for k in range(r.randint(1, 14))]
        docs[f"d{seed}"] = {t: [p for p in names if p != t and r.random() < (0.04 if seed % 3 else 0.15)] for t in names}
    got = ordered(spark, docs)
    for d, tables in docs.items():
        assert {t: got[d, t] for t in tables} == plain(tables)


def test_cycles(spark):
    docs = {"a": {"z": ["y"], "y": ["z"], "b": ["z"]}, "two": {"a": ["b"], "b": ["a"], "c": ["b", "d"], "d": ["c"], "e": []}}
    got = ordered(spark, docs)
    assert {t: got["a", t] for t in "zyb"} == {"y": 0, "z": 1, "b": 2}  # not "b", which only hangs on the cycle
    assert {t: got["two", t] for t in "abcde"} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    with pytest.raises(ValueError, match="among y, z$"):
        ordered(spark, {"a": docs["a"]}, strict=True)


def test_a_large_document_is_spread(spark):
    r = random.Random(5)
    tables = {f"t{k:05}": {f"t{r.randrange(max(1, k // 10), k):05}" for _ in range(2)} if k > 20 else set() for k in range(1, 20_001)}
    assert {t: v for (_, t), v in ordered(spark, {"big": tables}).items()} == plain(tables)


def test_nothing(spark):
    assert ordered(spark, {}) == {}
    assert ordered(spark, {"d": {"only": []}}) == {("d", "only"): 0}
