import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mockloom.llm import near
from mockloom.llm.components import components


def brute(docs, n, percent=80):
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, both = defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for ids in holders.values():
        both.update((ids[j], ids[i]) for i in range(len(ids)) for j in range(i))
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(documents, edges, n):
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 1000", "text"))
    want = brute(docs.distinct().collect(), n)
    got = near.near_duplicates(docs, n=n).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1:])) for i, k in enumerate([*range(60)] * 5)]
    docs += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(50)]
    want = brute(docs, 2)
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_null_ids_and_empty_table(spark, nothing):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()) == [(0, None, True), (3, 3, True), (4, 3, False)]
    assert near.near_duplicates(nothing).count() == 0


def test_representatives_keep_columns(edges):
    kept = near.representatives(edges, n=5)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9, 10, 11, 12]


def test_rows_of_one_id_with_different_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "one two three four five six"), (1, "a b c d e f g h"), (2, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in near.representatives(docs).collect()) == [(1, "a b c d e f g h"), (1, "one two three four five six"), (2, "")]


@pytest.mark.parametrize("most", [1, 100, 1 << 19])
def test_sets_are_confirmed_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(near, "SET_BLOCK", most)
    monkeypatch.setattr(near, "BUCKET_BLOCK", 8)
    r = np.random.default_rng(9)
    docs = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(40)]
        docs += [(100 * base + k, " ".join(np.where(r.random(40) < 0.06, f"x{base}{k}", words).tolist())) for k in range(40)]
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect()
    assert {d.doc_id: (d.n_shingles, d.component_id) for d in got} == brute(docs, 2)


def test_estimate_follows_similarity(spark):
    r = np.random.default_rng(3)
    rows = []
    for j in (0.2, 0.5, 0.8, 0.95):
        for _ in range(30):
            n = 400
            shared = int(round(2 * n * j / (1 + j)))
            a = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            rows.append((j, near.signature(a[:n])[1].tolist(), near.signature(a[n - shared:2 * n - shared])[1].tolist()))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    for j, e in df.withColumn("e", near.estimate(df.a, df.b)).groupBy("j").agg({"e": "avg"}).collect():
        assert abs(j - e) < 0.04


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 100), (300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 161)} | {301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
