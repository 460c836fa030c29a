import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mockloom.llm import quality
from mockloom.llm.batches import slices


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for k in range(3)}
    filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(filled) - len(set(filled)), len(covered))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.mark.parametrize("most", [1, 5000, 1 << 22])
def test_statistics_match_brute_force(documents, most):
    texts = [r.text for r in documents.collect()][:60] + [None, "", " ", "\n\n", "a\n\na\n a", "x y z x y z", "\n".join(["ab cd"] * 5), "é# ü\n", "\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for rows, data, bounds in slices(batch, "text", most):
        base, x = quality.statistics(data, bounds)
        assert x.shape == (rows.num_rows, len(quality.FEATURES)) and np.isfinite(x).all()
        for k, text in enumerate(rows.column(0).to_pylist()):
            assert tuple(int(base[b][k]) for b in quality.BASE) == brute(text), text


def features(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return quality.training_rows(docs, labels, "doc_id", "text")


def test_held_out_accuracy(spark, labels):
    x, y = features(spark, labels)
    odd = np.arange(len(y)) % 2 == 1
    trees = quality.fit(x[odd], y[odd], list(quality.FEATURES.values()))
    good = trees.score(x[~odd]) >= quality.KEEP
    assert (good == y[~odd]).mean() > 0.95
    assert good[y[~odd] == 1].mean() > 0.99  # clean documents stay


def test_scores_are_monotonic(spark, labels):
    x, y = features(spark, labels)
    trees = quality.fit(x, y, list(quality.FEATURES.values()))
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            moved = np.repeat(x[:40, None], 50, axis=1)
            moved[:, :, f] = np.linspace(0, x[:, f].max() * 1.5 + 0.1, 50)
            score = trees.score(moved.reshape(-1, x.shape[1])).reshape(40, 50)
            assert (sign * np.diff(score, axis=1) >= -1e-12).all()


def test_flat_trees_match_a_walk(spark, labels):
    x, y = features(spark, labels)
    t = quality.fit(x, y, list(quality.FEATURES.values()))
    for row, got in zip(x[:50], t.score(x[:50]), strict=True):
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.right[node] if row[t.feature[node]] > t.threshold[node] else t.left[node]
            total += t.value[node]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_judge_and_good(spark, documents, labels, edges, nothing):
    both = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 5000", "text"))
    got = quality.judge(both, labels).collect()
    texts = {r.doc_id: r.text for r in both.collect()}
    assert len(got) == both.count()
    for r in got:
        base = brute(texts[r.doc_id])
        assert tuple(r[k] for k in quality.BASE) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and r.kept == (not r.base_failed and r.score >= quality.KEEP)
    kept = quality.good(both, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.good(edges, labels).columns == edges.columns
    assert quality.judge(nothing, labels).count() == 0
    assert {r.kept == (not r.base_failed) for r in quality.judge(edges, labels.limit(0)).collect()} == {True}


def test_labels_are_chosen_among_those_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 20)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(10)] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)] + [(4, 1), (5, None)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels, "doc_id", "text")
    assert len(x) == 10 and sorted(y.tolist()) == [0.0] * 5 + [1.0] * 5
