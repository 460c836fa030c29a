"""Quality rules: base rules, and boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.llm.batches import slices
from mockloom.llm.words import hashes, mixed, windows, words

#: Labelled rows the trees are fitted on at most: those first in hash order.
TRAIN_ROWS = 4000
ROUNDS, DEPTH, RATE, CUTS, LEAST_WEIGHT, RIDGE = 30, 3, 0.3, 32, 2.0, 1.0
#: Score (probability of good quality) under which a document is rejected.
KEEP = 0.35
#: Base rules: least words, and the percentage of repeated words allowed.
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see; -1: the score may only fall as the value grows, 0: free.
FEATURES = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "mark_share": 0, "mean_word": 0, "words_per_line": 0, "comma_share": 0, "log_words": 0,
}
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: Symbols of the base statistics (fixed values).
SYMBOLS = _flag("#*$%&|<>")
_UPPER = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK, _COMMA = _flag("!?{}[]()=/\\_~^@+;:\"'"), _flag(",.")


def statistics(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics of each text, and the matrix of FEATURES."""
    n = len(bounds) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[bounds])

    begin, end, text = words(data, bounds)
    count = np.bincount(text, minlength=n)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    chars = np.bincount(text, weights=lead[end] - lead[begin], minlength=n).astype(np.int64)
    three, of = windows(hashes(data, begin, end), text, 3)
    _, where, times = np.unique(mixed(three + of.astype(np.uint64) * _SALT), return_inverse=True, return_counts=True)
    twice = (times[where] > 1) & (of >= 0)
    covered = np.zeros(len(text), bool)
    for k in range(3 if len(twice) else 0):
        covered[k:k + len(twice)] |= twice
    starts = np.zeros(len(data) + 1, bool)
    starts[bounds[:-1]] = True
    starts[1:] |= np.append(data == 10, False)[:-1]
    # a text's end is no line of the next text, and empty texts have no line with a word
    first = np.flatnonzero(starts[:-1]) if len(data) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(data))
    last = np.where((last > first) & (np.append(data, 0)[last - 1] == 10) if len(first) else False, last - 1, last)
    filled = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    first, last = first[filled], last[filled]
    line_text = np.searchsorted(bounds, first, side="right") - 1
    line = mixed(hashes(data, first, last) + line_text.astype(np.uint64) * _SALT)
    lines = np.bincount(line_text, minlength=n)
    distinct = np.bincount(line_text[np.unique(line, return_index=True)[1]], minlength=n)
    base = dict(zip(BASE, (count, chars, per_text(SYMBOLS[data]), lines - distinct, np.bincount(text, weights=covered, minlength=n).astype(np.int64)), strict=True))
    total, several = np.maximum(chars, 1), np.maximum(count, 1)
    matrix = np.column_stack([
        base["n_symbols"] / total, base["n_dup_lines"] / np.maximum(lines, 1), base["n_repeat_words"] / several, per_text(_UPPER[data]) / total,
        per_text(_MARK[data]) / total, chars / several, count / np.maximum(lines, 1), per_text(_COMMA[data]) / total, np.log1p(count)])
    return base, matrix


class Trees(NamedTuple):
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row: all rows go down one tree at a time, a level a step."""
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[row, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            out += self.value[node]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Boosted trees for the log-odds of ``y``, Newton leaves, monotonic in features with a sign.

    A split on such a feature must order its two leaf values by the sign, and the
    values below it stay on their side of the middle of the two.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    nodes: list[list[float]] = []
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    raw, roots = np.full(len(y), base), []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, 0.0, me, me, RATE * leaf(g, h, low, high)])
        raw[rows] += 0 if depth < DEPTH else RATE * leaf(g, h, low, high)
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f, c in enumerate(cuts if depth < DEPTH else []):
            gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(c) + 1))[:-1]
            gr, hr = g - gl, h - hl
            wl, wr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
            gain = -(gl * wl + 0.5 * (hl + RIDGE) * wl**2 + gr * wr + 0.5 * (hr + RIDGE) * wr**2) - g * g / (h + RIDGE) / 2
            gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | (signs[f] * (wr - wl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        if best[1] < 0:
            if depth < DEPTH:
                raw[rows] += RATE * leaf(g, h, low, high)
            return me
        _, f, k, wl, wr = best
        middle, goes = (wl + wr) / 2, binned[rows, f] > k
        bounds = [(low, high), (low, high)]
        if signs[f] > 0:
            bounds = [(low, middle), (middle, high)]
        elif signs[f] < 0:
            bounds = [(middle, high), (low, middle)]
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = grow(rows[~goes], depth + 1, *bounds[0])
        nodes[me][3] = grow(rows[goes], depth + 1, *bounds[1])
        return me

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), base)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of at most TRAIN_ROWS labelled documents of ``docs``, the first in hash order.

    Labels of other documents are left out first, so a part of a corpus has as many
    rows to fit on as its own labels allow. Of labels that contradict each other, and of repeated ids' texts, the smallest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].alias("_y")).where("_id is not null and _y is not null")
    here = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("text"))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).join(here.select("_id"), "_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    source = here.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                x = pa.array(list(statistics(data, bounds)[1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.int32()), x], names=["id", "y", "x"])

    found = source.mapInArrow(run, "id long, y int, x array<double>").orderBy("id").collect()
    return np.array([r.x for r in found]).reshape(len(found), len(FEATURES)), np.array([r.y for r in found], float)


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees fitted on labelled documents; None without labels of both kinds."""
    x, y = training_rows(docs, labels, id_col, text_col)
    return fit(x, y, list(FEATURES.values())) if len(set(y.tolist())) > 1 else None


def _judged(data: np.ndarray, bounds: np.ndarray, trees: Trees | None):
    base, x = statistics(data, bounds)
    failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
    score = trees.score(x) if trees else np.ones(len(x))
    return base, failed, score, ~failed & (score >= KEEP)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base statistics, base_failed, score, kept) of every row.

    The trees are fitted on a bounded sample of the labels (TRAIN_ROWS) and go to
    the tasks as node arrays; statistics and scores of all rows take one pass
    without a shuffle. A rejected document fails the base rules, or scores under KEEP.

    A null text has no words and fails. Labels that are null, or of unknown
    documents, are left out; without both kinds of label the base rules decide
    alone. Repeated rows and null ids are kept as rows; an empty table gives no rows.
    """
    trees = model(docs, labels, id_col, text_col)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", *BASE, "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                base, failed, score, kept = _judged(data, bounds, trees)
                columns = [rows.column(0), *[pa.array(base[k], pa.int64()) for k in BASE], pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, ", ".join(["doc_id long", *[f"{k} long" for k in BASE], "base_failed boolean, score double, kept boolean"]))


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are."""
    trees = model(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, text_col):
                yield rows.filter(pa.array(_judged(data, bounds, trees)[3]))

    return docs.mapInArrow(run, docs.schema)
