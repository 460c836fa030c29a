import re
from collections import defaultdict

import pytest

from mockloom.llm import lines


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, least=2):
    seen = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                seen[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (len(seen[key(x)]) >= least and min(seen[key(x)]) != doc)]
        out[doc] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_against_brute_force(documents, edges, least):
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 1000", "text"))
    want = brute(docs.collect(), least)
    got = lines.line_dedup(docs, min_docs=least).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.text, r.n_lines, r.n_dropped) == want[r.doc_id]


def test_clashing_columns_null_ids_empty_table(spark, edges, nothing):
    assert lines.line_dedup(edges).count() == edges.count()
    docs = spark.createDataFrame([(None, "the same long line"), (2, "the same long line"), (1, "The same long line ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.line_dedup(docs).collect()} == {None: "the same long line", 1: "The same long line ", 2: ""}
    assert lines.line_dedup(nothing).count() == 0


def test_length_counts_code_points(spark):
    docs = spark.createDataFrame([(1, "éééééééééé"), (2, "éééééééééé"), (3, "ééééééééé"), (4, "ééééééééé")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.line_dedup(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
