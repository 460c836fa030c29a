"""Token counts of whole texts by a tokenizer compiled to a finite-state transducer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mockloom.llm.batches import slices
from mockloom.llm.bpe import Transducer, Vocabulary
from mockloom.llm.split import Splitter


class Encoder:
    """Splitter and transducer of one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.split = Splitter(self.vocabulary.special)
        self.machine = Transducer(self.vocabulary)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray):
        begin, special = self.split(data, bounds)
        end = np.append(begin[1:], len(data))
        text = np.searchsorted(bounds, begin, side="right") - 1
        return begin, end, special, text

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        begin, end, special, text = self._pieces(data, bounds)
        count = np.ones(len(begin), np.int64)
        plain = special < 0
        count[plain] = self.machine.run(data, begin[plain], end[plain])
        return np.bincount(text, weights=count, minlength=len(bounds) - 1).astype(np.int64)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in order, and the number of each text.

        The transducer notes the last token at every byte; from the end of a
        piece the tokens are read off backwards, all pieces side by side.
        """
        begin, end, special, text = self._pieces(data, bounds)
        count = np.ones(len(begin), np.int64)
        plain = np.flatnonzero(special < 0)
        last = np.empty(len(data), np.int32)
        count[plain] = self.machine.run(data, begin[plain], end[plain], last)
        until = np.cumsum(count)
        out = np.empty(int(until[-1]) if len(until) else 0, np.int32)
        out[until[special >= 0] - 1] = special[special >= 0]
        length = self.vocabulary.length
        b, at, to = begin[plain], end[plain], until[plain]
        while len(b):
            token = last[at - 1]
            to, at = to - 1, at - length[token]
            out[to] = token
            more = at > b
            b, at, to = b[more], at[more], to[more]
        return out, np.bincount(text, weights=count, minlength=len(bounds) - 1).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker; workers keep it between tasks."""
    return Encoder(path)


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file: a name of the public_tokenizers package, or a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    The vocabulary file of a byte-level BPE is compiled to a deterministic
    transducer (see ``bpe``) whose transitions carry token counts. No shuffle: each
    batch of texts is cut in pieces, which run side by side through the transducer.

    A null text is empty: 0 bytes, 0 tokens. Rows are kept as they are, repeated or
    null ids included; an empty table gives no rows; other columns are ignored. A
    text of any length is counted whole; memory follows the longest text.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer_file(tokenizer)).counts
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                n = count(data, bounds)
                columns = [rows.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
