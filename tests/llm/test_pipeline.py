import pytest

import corpus_pipeline
from mockloom.llm import decontaminate, near, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Output of each stage, cached."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_in_turn(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good, single, clean, mixed, written = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality.judge(docs, labels).where("kept"))
    assert ids(single) == ids(near.near_duplicates(good).where("kept"))
    leaked = set(ids(decontaminate.matches(single, benchmark)))
    assert ids(clean) == [d for d in ids(single) if d not in leaked]
    assert set(ids(mixed)) <= set(ids(clean)) and mixed.count() > 0
    assert ids(written) == ids(mixed)
    rows = sorted(tuple(r) for r in written.select("doc_id", "start", "n_tokens").collect())
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:k]) for k in range(len(rows))]


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_edges_go_through(spark, edges, nothing):
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
