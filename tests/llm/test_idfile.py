import heapq
import zlib

import numpy as np
import pytest

from mockloom.llm import idfile
from mockloom.session import scratch_path

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_codes_and_round_trip(n):
    r = np.random.default_rng(n)
    counts = (r.pareto(0.6, n) * 3 + 1).astype(np.int64)
    lengths = idfile.code_lengths(counts)
    assert lengths.max() <= idfile.LIMIT and (n == 1 or abs((2.0**-lengths).sum() - 1) < 1e-9)
    heap, best = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        best += pair
        heapq.heappush(heap, pair)
    total = int((lengths * counts).sum())
    assert n == 1 or best <= total <= 1.02 * best + 1 and (lengths.max() == idfile.LIMIT or total == best)
    ids = np.sort(r.choice(60_000, n, replace=False))
    code = idfile.canonical(ids, lengths)
    text = r.choice(ids, 5000, p=counts / counts.sum())
    bits, offsets = idfile.pack(text, code)
    assert (idfile.unpack(bits, offsets, idfile.stretches(np.array([5000])), code) == text).all()
    k = 7  # from a checkpoint
    part = idfile.unpack(bits, offsets[k:k + 1], np.array([idfile.STRETCH]), code)
    assert (part == text[k * idfile.STRETCH:(k + 1) * idfile.STRETCH]).all()


@pytest.mark.parametrize("block_ids", [100, 1 << 18])
def test_file_against_the_library(spark, documents, edges, block_ids, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idfile, "BLOCK_IDS", block_ids)
    library = Tokenizer.from_file(FILE)
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 1000", "text")).repartition(5)
    path = scratch_path(spark, "ids")
    idfile.write_ids(docs, path, FILE, 2)
    got = sorted(tuple(r) for r in idfile.digest(idfile.read_ids(spark, path)).collect())
    want, start = [], 0
    for doc, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, nothing):
    path = scratch_path(spark, "ids")
    idfile.write_ids(nothing, path, FILE)
    assert idfile.read_ids(spark, path).count() == 0
