"""Lines repeated across documents are kept in one document only."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.llm.store import written

#: What is stripped at both ends of a line (fixed values).
BLANK = b" \t\n\x0b\x0c\r"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lowered, None for short ones."""
    line = line.strip(BLANK)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return blake2b(line.lower(), digest_size=16).digest()  # bytes.lower() knows A-Z only


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without lines that ``min_docs`` documents or more hold.

    Lines are normalised and hashed once for each document; hashes are counted
    with map-side sums; those over the threshold go from every document but the
    smallest id that holds them, and the rest is joined again in its order. A
    line of a third of all documents is one row of counts, and its rows are an
    ordinary join that Spark splits; a document gathers its own hashes only.

    A null or empty text is one empty line. Rows that share an id count as one
    document and lose the same lines. Rows with a null id are left whole and do not count. Lines of
    fewer than ``min_chars`` code points always stay. An empty table gives no rows.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {_key(line, min_chars) for line in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")}
                found.discard(None)
                ids += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "key"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts = raw.split(b"\n")
                drop = set(gone.as_py()) if gone.is_valid else ()
                kept = [x for x in parts if _key(x, min_chars) not in drop] if drop else parts
                texts.append(b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_lines", "n_dropped"])

    found = source.where("doc_id is not null").mapInArrow(keys, "doc_id long, key binary")
    enough = F.col("first") < F.col("last") if min_docs == 2 else F.col("docs") >= min_docs
    many = [F.count_distinct("doc_id").alias("docs")] if min_docs > 2 else []
    repeated = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *many).where(enough).select("key", "first")
    repeated = written(repeated, "line-keys")  # so that both sides of the join are dealt by it, and a hot key's rows can be split
    gone = found.join(repeated, "key").where("doc_id != first").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    return source.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long")
