import random

import numpy as np
import pytest

from mockloom.llm import pieces

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")


def texts(seed, n):
    r = random.Random(seed)
    bits = ["the", " of", "'s", "'ll", " 'tis", "\n", "\n\n ", "\t", "  ", "0", "12345678", "é", "ß", "😀", "　", "a\0", "a", "\0", "x" * 15, "y" * 16, " " + "z" * 40, "!?", "</s>", "<s>", "<unk>", "日本語", "\r\n"]
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(300)]
    return ["".join(r.choice(bits) if r.random() < 0.5 else " " + r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]


def batch(rows):
    raw = [t.encode() for t in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("kept", [64, 1 << 20])
def test_against_the_library(kept, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(pieces, "KEPT_LONG", 3)
    library = Tokenizer.from_file(FILE)
    encoder = pieces.LibraryEncoder(FILE, kept)
    for seed in range(12):
        rows = texts(seed, 60)
        ids, count = encoder.ids(*batch(rows))
        want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want]
    ids, count = encoder.ids(*batch(["", ""]))
    assert not len(ids) and count.tolist() == [0, 0]


def test_table_keeps_what_was_met_again():
    table = pieces.Table(1 << 10)

    def keys(values):
        return np.array(values, np.uint64), np.full(len(values), 8 << 56, np.uint64)

    for start in range(0, 20_000, 100):
        table.make_room()
        here = keys(range(start, start + 100))
        table.add(*here, np.arange(start, start + 100, dtype=np.int32), np.ones(100, np.uint8))
        table.met[table.place(*keys(range(10)))] = True
    at = table.place(*keys(range(10)))
    assert (table.high[at] != 0).all() and table.ids[table.begin[at]].tolist() == list(range(10))
    assert table.filled < 1200 and len(table.high) <= 1 << 11
