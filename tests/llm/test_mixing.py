import re
from collections import Counter

from mockloom.llm import mixing


def wanted(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def check(docs, slack):
    rows = [(r.doc.doc_id, r.doc.text, r.doc.source, r.mix) for r in mixing.mix(docs).collect()]
    assert len(rows) == docs.count()
    size, taken = Counter(), Counter()
    for _, text, source, m in rows:
        assert m["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= m["copies"] <= 3
        size[source] += m["size"]
        taken[source] += m["size"] * m["copies"]
    target = wanted(size)
    for _, _, source, m in rows:
        assert m["source_size"] == size[source] and abs(m["target"] - target[source]) < 1e-6 * (1 + m["target"])
    for s in size:
        assert abs(taken[s] - target[s]) <= slack * max(1, target[s]), s


def test_targets_and_draws(documents):
    check(documents, 0.06)


def test_edges(edges, nothing):
    check(edges, 1e9)
    assert mixing.mix(nothing).count() == 0


def test_copies_agree_and_keep_columns(documents, edges):
    once = sorted(r.doc_id for r in mixing.repeated(documents).collect())
    assert once == sorted(r.doc_id for r in mixing.repeated(documents.repartition(7)).collect())
    copies = {r.doc.doc_id: r.mix["copies"] for r in mixing.mix(documents).collect()}
    assert Counter(once) == Counter({d: c for d, c in copies.items() if c})
    assert mixing.repeated(edges).columns == edges.columns


def test_capped_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] * 2 + ["b"] * 30 + ["c"] * 100 + [None] * 3)], "doc_id long, text string, source string")
    check(docs, 0.02)
