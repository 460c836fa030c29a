import random

import pytest

from mockloom.llm import decontaminate as dc


def sellers(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def edited(text, n, r):
    chars = list(text)
    for _ in range(n):
        k = r.randrange(len(chars))
        kind = r.random()
        if kind < 0.33:
            chars[k] = r.choice("abcdez ")
        elif kind < 0.66:
            del chars[k]
        else:
            chars.insert(k, r.choice("abcxyz "))
    return "".join(chars)


def test_edits_against_the_full_table(benchmark, documents):
    items = [dc.as_item(r.item_id, dc.normal(r.text.encode())) for r in benchmark.collect()]
    texts = [r.text for r in documents.limit(40).collect()]
    find, r = dc.Finder(items), random.Random(3)
    for _ in range(60):
        k = r.randrange(len(items))
        text = dc.normal((r.choice(texts)[:200] + edited(items[k].text, r.randint(0, items[k].budget + 2), r) + r.choice(texts)[:100]).encode())
        best = sellers(items[k].text, text)
        assert dc.distance(items[k], text) == best
        assert (k in find(text)) == (best <= items[k].budget)


def test_planted_passages(spark, benchmark, documents):
    items = {r.item_id: r.text for r in benchmark.collect()}
    own = dc.matches(documents, benchmark).collect()
    texts = {r.doc_id: dc.normal(r.text.encode()) for r in documents.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if dc.normal(x.encode()) in t}
    assert exact and exact == {(r.doc_id, r.item_id) for r in own}
    r = random.Random(4)
    made = [(100 + i, "intro words " + edited(x, 3, r).upper().replace(" ", "  ") + "\nend") for i, x in items.items() if len(x) >= dc.EXACT_BELOW]
    found = {r.doc_id for r in dc.matches(spark.createDataFrame(made, "doc_id long, text string"), benchmark).collect()}
    assert found == {d for d, _ in made}


def test_blocks_find_the_same(documents, benchmark, monkeypatch):
    whole = sorted(tuple(r) for r in dc.matches(documents, benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 2500)
    assert sorted(tuple(r) for r in dc.matches(documents, benchmark).collect()) == whole
    assert dc.clean(documents, benchmark).count() == documents.count() - len({d for d, _, _ in whole})


def test_edges(spark, edges, nothing, benchmark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "solo"), (3, "solo"), (None, "shared line of text")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in dc.matches(edges, items).na.fill(-1).collect())
    assert got == [(7, 3, 0), (8, 3, 0), (9, -1, 0), (10, -1, 0), (11, -1, 0)]
    kept = dc.clean(edges, items)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 5
    assert dc.matches(nothing, benchmark).count() == 0 and dc.matches(edges, benchmark.limit(0)).count() == 0
