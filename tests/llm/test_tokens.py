import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mockloom.llm import tokens
from mockloom.llm.batches import slices
from mockloom.llm.bpe import Transducer

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def ids_of(texts, most=100_000):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for rows, data, bounds in slices(batch, "text", most):
        count = tokens.encoder(FILE).counts(data, bounds)
        ids, again = tokens.encoder(FILE).ids(data, bounds)
        assert (count == again).all()
        yield from zip(rows.column(0).to_pylist(), np.split(ids, np.cumsum(count)[:-1]), strict=True)


def test_ids_are_the_librarys(library):
    r = random.Random(1)
    parts = [*" '\n\t sStTreREvVlLmMdD1234!?.,-é中文 　́²½Ⅷ😀<|>\x00\x1c\x85​", "<|endoftext|>", "'s", "'re", "'ll", "  ", " '", "<|endo", "the", "ing"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "-" * 9000, "ab" * 3000, "ÃÂ" * 2000, " " * 3000, "\n" * 2500 + "x", "".join(r.choice("abcdefghij") for _ in range(20_000)), None, ""]
    for text, got in ids_of(texts):
        assert library.encode(text or "", add_special_tokens=False).ids == got.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = whole
    for text, got in ids_of(texts, 50):
        assert whole.encode(text, add_special_tokens=False).ids == got.tolist()


def test_small_table_starts_anew():
    machine = Transducer(tokens.encoder(FILE).vocabulary, max_transitions=50)
    data = np.frombuffer(b"wonderful antidisestablishmentarianism", np.uint8)
    want = tokens.encoder(FILE).machine.run(data, np.array([0, 9]), np.array([9, len(data)]))
    for _ in range(3):
        assert (machine.run(data, np.array([0, 9]), np.array([9, len(data)])) == want).all()


def test_counts_of_a_table(edges, nothing, library):
    got = tokens.token_counts(edges, FILE, limit=100).collect()
    assert len(got) == edges.count()
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    assert tokens.token_counts(nothing, FILE).count() == 0
