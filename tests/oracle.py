"""Run a registered query and its SQL side by side on the same files."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

LAST = {"spark": 0.0}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value) if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else x for x in t)
    )


def compare(spark, con, query, sql: str, sf_dir: str):
    """Return None when equal, otherwise a short description of the difference."""
    start = time.time()
    frame = query(spark, sf_dir)
    collected = frame.collect()
    LAST["spark"] = time.time() - start
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in collected])
    found = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in found.description], found.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only here {list(set(got) - set(want))[:3]}; only SQL {list(set(want) - set(got))[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[:3]}" if bad else None
