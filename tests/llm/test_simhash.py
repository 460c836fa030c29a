import re

import numpy as np
import pytest
import xxhash

from mockloom.llm import simhash


def plain_print(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius):
    """Smallest id reachable of every (id, fingerprint)."""
    ids = sorted({i for i, _ in prints})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_id = sorted(prints)
    values = np.array([p for _, p in by_id], np.uint64)
    for k, (i, p) in enumerate(by_id):
        for other in np.flatnonzero(np.bitwise_count(values[:k] ^ np.uint64(p)) <= radius):
            x, y = sorted((find(i), find(by_id[other][0])))
            root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [3, 5])
def test_against_brute_force(documents, edges, n):
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 1000", "text"))
    rows = [(r.doc_id, plain_print(r.text, n)) for r in docs.collect()]
    want = grouped(rows, 3)
    got = simhash.near_duplicates(docs, n=n).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{p:016x}") for i, p in rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_balls_meet_exactly_within_the_radius(radius):
    r = np.random.default_rng(radius)
    for distance in range(7):
        for _ in range(40):
            a = r.integers(0, 1 << 63, 1, dtype=np.uint64)
            bits = r.choice(64, distance, replace=False) if distance != 3 or r.random() < 0.5 else r.choice(16, 3, replace=False) + 16 * r.integers(4)
            b = a ^ np.uint64(sum(1 << int(k) for k in bits))
            if distance <= radius:
                assert set(simhash.ball(a, radius)[0].tolist()) & set(simhash.ball(b, radius)[0].tolist())
    assert simhash.ball(a, radius).shape[1] == {0: 1, 1: 4, 2: 65, 3: 196}[radius]


def linked(spark, prints, radius=3):
    """Components of given fingerprints, through the operator's own steps."""
    made, simhash.fingerprints = simhash.fingerprints, lambda docs, n: docs.selectExpr("doc_id", "cast(text as long) as print")
    try:
        rows = [(i, str(int(np.uint64(p).view(np.int64)))) for i, p in prints]
        return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius).collect()}
    finally:
        simhash.fingerprints = made


@pytest.mark.parametrize("block", [64, 8])
def test_dense_clusters_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BUCKET_BLOCK", block)
    r = np.random.default_rng(5)
    prints = []
    for center in r.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        for _ in range(150):
            bits = r.choice(12, r.integers(0, 5), replace=False) * 5
            prints.append(center ^ sum(1 << int(k) for k in bits))
    value = int(r.integers(0, 1 << 62))
    for k in range(20):  # each three bits from the last
        prints.append(value)
        value ^= 7 << 3 * k
    prints += [0, 7, 15, 255] + r.integers(0, 1 << 63, 50, dtype=np.uint64).tolist()
    rows = list(enumerate(prints))
    r.shuffle(rows)
    rows = [(int(i), int(p)) for i, p in rows]
    assert linked(spark, rows) == grouped(rows, 3)


def test_null_ids_and_empty_table(spark, nothing):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (4, "A  b c"), (5, None), (6, " ")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in simhash.near_duplicates(docs, n=3).collect())
    assert got == [(0, None, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False)]
    assert simhash.near_duplicates(nothing).count() == 0


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "SHINGLES", 64)
    assert simhash.fingerprint(text, 3) == whole == plain_print(text.decode(), 3)
