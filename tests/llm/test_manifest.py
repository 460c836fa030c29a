from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mockloom.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def brute(nodes):
    """Root of a list of nodes, and the siblings of each, level by level: (left, right)."""
    siblings, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k:k + 3]
            for i in range(len(run)):
                for leaf in under[k + i]:
                    siblings[leaf].append(("".join(run[:i]), "".join(run[i + 1:])))
            above.append(h("".join(run)))
            held.append([x for u in under[k:k + 3] for x in u])
        nodes, under = above, held
    return nodes[0], siblings


def expected(rows):
    """(id, group, leaf) to (subroot, root, witness), in order of the tree."""
    groups = defaultdict(list)
    for i, g, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups[g].append((i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute([leaf for _, leaf in groups[g]]) for g in names]
    root, above = brute([t[0] for t in trees])
    return sorted((repr(i), leaf, repr(g), t[0], root, w + u) for g, t, u in zip(names, trees, above) for (i, leaf), w in zip(groups[g], t[1]))


def got(df):
    rows = manifest.manifest(df).collect()
    return sorted((repr(r.row.doc_id), r.leaf, repr(r.row.source), r.subroot, r.root, [(w.left, w.right) for w in r.witness]) for r in rows)


@pytest.mark.parametrize("sizes", [[1], [2, 3, 1], [4, 9, 10, 27, 28], [730, 1, 2200], [729, 1458, 5]])
def test_against_brute_force(spark, sizes):
    rows = [(1000 * k - i, f"s{k}", h(f"{k}/{i}")) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5)
    assert got(df) == expected(rows)


def test_many_groups(spark):
    rows = [(i, f"host-{i % 900}é" if i % 7 else None, h(str(i))) for i in range(2000)]
    assert got(spark.createDataFrame(rows, "doc_id long, source string, leaf string")) == expected(rows)


def test_edges(edges, nothing):
    leaves = edges.withColumn("leaf", manifest.digest(*[edges[c] for c in ("doc_id", "source", "n", "text")]))
    rows = [(r.doc_id, r.source, r.leaf) for r in leaves.collect()]
    text = "naïve café 😀 line here\nshared line of text\n\nshared line of text"
    assert dict((r[0], r[2]) for r in rows)[9] == h(f"1:91:d1:7{len(text.encode())}:{text}")
    assert dict((r[0], r[2]) for r in rows)[1] == h("1:11:a1:7-")
    assert got(leaves) == expected(rows)
    made = manifest.manifest(leaves)
    assert set(made.select("row.*").columns) == set(leaves.columns)
    empty = nothing.withColumn("leaf", manifest.digest(nothing["doc_id"]))
    assert manifest.manifest(empty).count() == 0


def test_null_ids_and_repeats(spark):
    rows = [(None, None, h("a")), (None, None, h("b")), (5, None, h("c")), (5, None, h("c")), (5, "", h("d")), (7, "", h("e"))]
    assert got(spark.createDataFrame(rows, "doc_id long, source string, leaf string")) == expected(rows)


def test_fold_shows_tampering(spark, documents):
    leaves = documents.select("doc_id", "source", manifest.digest(documents["text"]).alias("leaf"), manifest.digest(F.concat("text", F.lit("x"))).alias("other"))
    made = manifest.manifest(leaves)
    honest, tampered = manifest.fold(F.col("leaf"), F.col("witness")), manifest.fold(F.col("row.other"), F.col("witness"))
    assert made.where(honest != F.col("root")).count() == 0
    assert made.where((tampered == F.col("root")) & F.col("row.other").isNotNull() & (F.col("row.other") != F.col("leaf"))).count() == 0
