import random
import re
import zlib
from collections import Counter

import pytest

from mockloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, times=5):
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(beside[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def invented(seed, n):
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + r.choice("abcé😀") + w[k:], w[:k] + "z" + w[k + 1:]}
    return {w: r.choice([1, 2, 5, 10, 30, 200]) for w in sorted(words) if w}


def plain_counts(docs, drop):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{doc if doc is not None else 'null'}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                total[run] += 1
    return total


@pytest.mark.parametrize("most", [20_000, 12])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST", most)
    counts = invented(most, 250)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == brute(counts)


def test_acceptor_is_minimal_and_gives_each_pair_once():
    words = sorted(invented(3, 120))
    a = spelling.Acceptor(words)
    pairs = [tuple(sorted(p)) for p in a.pairs()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(v, w) for v in words for w in words if v < w and near(v, w)}
    language = {}
    for state in range(len(a.next)):  # states are numbered after those they lead to
        language[state] = frozenset({""} if a.final[state] else set()) | frozenset(c + x for c, s in a.next[state].items() for x in language[s])
    assert len(set(language.values())) == len(language) and language[a.initial] == set(words)


def test_counts(spark, documents, edges, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id", "text")).union(spark.sql("select cast(null as long), 'Überlänge überlänge NAÏVETÉ naïveté x'"))
    want = plain_counts(docs.collect(), 7)
    assert dict(map(tuple, spelling.word_counts(docs, drop=7).collect())) == want
    assert not dict(map(tuple, spelling.word_counts(docs).collect())) == want


def test_very_long_words_and_edges(spark, edges, nothing):
    long_ = "a" * 50_000
    text = f"{long_} {long_}a {'a' * 20_000}b{'a' * 29_999} " * 5
    got = {r.word: r.n_near for r in spelling.spelling_variants(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert sorted(got.values()) == [1, 1, 2] and got[long_] == 2
    assert {r.word: (r.n, r.root) for r in spelling.spelling_variants(edges, occurrences=2).collect()} == {"shared": (4, "shared"), "eleven": (3, "eleven"), "twelve": (3, "twelve")}
    assert spelling.spelling_variants(nothing).count() == 0


def test_chain_of_forms(spark):
    counts = {"colour": 5, "color_": 1, "coloure": 25, "colourex": 200, "colourexy": 2000, "unlike": 9}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["colour"] == "colourexy" and got["unlike"] == "unlike"
