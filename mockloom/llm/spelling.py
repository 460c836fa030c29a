"""Spelling variants: words of a vocabulary that are one edit apart, and the commoner form of each.

The pairs are the language of a composition: acceptor of the vocabulary, a
transducer that makes one edit, and the acceptor again. Its initial states are
dealt out: a pair that differs after half of the word shares the state that this
half leads to, and a pair that differs before it shares the same of the words
read backwards. So each partition is the acceptor behind one such state,
minimised, and all accepted pairs are those of the partitions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mockloom.llm.batches import slices
from mockloom.llm.store import written
from mockloom.operators.scan import lookup_by_key

#: Code points of a word at least.
LEAST = 6
#: Words counted in a task before counts are passed on.
COUNTED = 200_000
#: Words of a partition from which it is split at its next letter.
MOST = 20_000
#: Pairs put out at once.
ROWS_OUT = 4096


def word_counts(docs: DataFrame, least: int = LEAST, drop: int | None = None) -> DataFrame:
    """(word, n): occurrences of runs of letters of at least ``least`` code points, A-Z lowered.

    With ``drop``, a run whose ``<doc_id>:<run>`` has a CRC-32 that ``drop`` divides loses the code point at CRC-32 modulo its length first.
    """
    run_of = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                raw = data.tobytes()
                for doc, a, b in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found = Counter(run_of.findall(raw[a:b].lower().decode()))  # of bytes: A-Z only
                    if drop:
                        seed = zlib.crc32(f"{doc if doc is not None else 'null'}:".encode())
                        for word in list(found):
                            h = zlib.crc32(word.encode(), seed)
                            if h % drop == 0:
                                n, at = found.pop(word), h % len(word)
                                total[word[:at] + word[at + 1:]] += n
                    total.update(found)
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.mapInArrow(run, "word string, n long")
    return counted.where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimised acceptor of sorted words: states are numbered, equal right languages share one."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], bool] = {}
        # states of the path of the last word, still open: (letters out, whether a word ends here)
        path: list[list] = [[{}, False]]
        before = ""
        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            self._shut(path, before, same)
            path.extend([{}, False] for _ in word[same:])
            path[-1][1] = True
            before = word
        self._shut(path, before, 0)
        self.initial = self._state(path[0])

    def _state(self, state: list) -> int:
        key = (state[1], *sorted(state[0].items()))
        number = self._known.get(key)
        if number is None:
            number = self._known[key] = len(self.next)
            self.next.append(state[0])
            self.final.append(state[1])
        return number

    def _shut(self, path: list[list], word: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def meets(self, p: int, q: int) -> bool:
        """Whether some text leads from both states to the end of a word."""
        stack = [self._visit(p, q)]
        while stack:
            pair, children = stack[-1]
            if pair not in self._meets:
                child = next(children, None)
                if child is None:
                    self._meets[pair] = False
                elif self._meets.get(child) is None:
                    stack.append(self._visit(*child))
                elif self._meets[child]:
                    self._meets[pair] = True
                continue
            stack.pop()
            if self._meets[pair]:
                self._meets.update((above, True) for above, _ in stack)
                return True
        return False

    def _visit(self, p: int, q: int) -> tuple[tuple[int, int], Iterator[tuple[int, int]]]:
        pair = (p, q) if p <= q else (q, p)
        if p == q or self.final[p] and self.final[q]:
            self._meets[pair] = True
        a, b = self.next[p], self.next[q]
        return pair, (tuple(sorted((s, b[c]))) for c, s in a.items() if c in b)

    def common(self, p: int, q: int, first_not: str = "") -> Iterator[str]:
        """Texts that lead from both states to the end of a word, but those that begin with one letter."""
        stack: list[tuple[int, int, tuple | None]] = [(p, q, None)]
        while stack:
            p, q, read = stack.pop()
            if self.final[p] and self.final[q]:
                yield _text(read)
            b = self.next[q]
            for c, s in self.next[p].items():
                if c in b and (read is not None or c != first_not) and self.meets(s, b[c]):
                    stack.append((s, b[c], (read, c)))

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Words that the composition with one edit accepts: one code point replaced, or one left out.

        Of equal letters in a row the last one is left out, so each pair comes once.
        """
        stack: list[tuple[int, tuple | None]] = [(self.initial, None)]
        while stack:
            state, read = stack.pop()
            out = sorted(self.next[state].items())
            for k, (c, s) in enumerate(out):
                stack.append((s, (read, c)))
                for d, t in out[k + 1:]:
                    if self.meets(s, t):
                        begin = _text(read)
                        for rest in self.common(s, t):
                            yield begin + c + rest, begin + d + rest
                if self.meets(s, state):
                    begin = None
                    for rest in self.common(s, state, c):
                        begin = _text(read) if begin is None else begin
                        yield begin + c + rest, begin + rest


def _text(read: tuple | None) -> str:
    """Letters of a linked path."""
    letters = []
    while read is not None:
        read, c = read
        letters.append(c)
    return "".join(reversed(letters))


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of partitions whose rows stand together."""
    out: list[tuple[str, str, int]] = []
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (back, _, shared), members in groupby(rows, key=itemgetter(0, 1, 2)):
        counts = {r[3]: r[4] for r in members}
        cut = len(shared)
        rests = {(w[:len(w) - cut][::-1] if back else w[cut:]): w for w in counts}
        for x, y in Acceptor(sorted(rests)).pairs():
            v, w = rests[x], rests[y]
            out += [(v, w, counts[w]), (w, v, counts[v])]
        if len(out) >= ROWS_OUT:
            yield _near_rows(out)
            out = []
    yield _near_rows(out)


def _near_rows(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])


def _partitions(words: DataFrame) -> DataFrame:
    """(back, size, shared, word, n): each word under the states that its halves lead to.

    ``size`` is the shorter length of a partition's pairs; a word is there with
    words of its own length, and with those one shorter.
    """
    length = F.char_length("word")
    sized = words.withColumn("size", F.explode(F.array(length, length - 1)))
    half = F.floor(F.col("size") / 2).cast("int")
    return sized.select("word", "n", "size", F.explode(F.array(
        F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), half).alias("shared")),
        F.struct(F.lit(True).alias("back"), F.substring("word", -(F.col("size") - half), F.col("size") - half).alias("shared")))).alias("p")).select("p.*", "size", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways: words of a vocabulary (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Partitions of over MOST words are split: pairs that go on with the same letter
    move to the state behind it, and pairs that differ in the very next one are words equal but for that
    place, found under what is left without it; such a partition has at most one
    word for each letter. So no task holds more than MOST words at once, or one for each letter.
    """
    keys = ["back", "size", "shared"]
    open_, found = written(_partitions(words), "spelling-partitions"), []
    while True:
        sizes = written(open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).where("words > 1"), "spelling-sizes")
        small = lookup_by_key(open_, sizes.where(F.col("words") <= MOST), keys)
        together = small.select(*keys, "word", "n").repartition(*keys).sortWithinPartitions(*keys)
        found.append(together.mapInArrow(_accepted, "word string, near string, near_n long"))
        large = sizes.where(F.col("words") > MOST)
        if large.isEmpty():
            break
        rows = written(lookup_by_key(open_, large, keys).drop("words"), "spelling-large")
        found.append(_next_letter(rows))
        deep = F.char_length("shared")
        more = F.char_length("word") > deep
        longer = F.when(F.col("back"), F.substring("word", -(deep + 1), deep + 1)).otherwise(F.substring("word", F.lit(1), deep + 1))
        open_ = written(rows.where(more).withColumn("shared", longer), "spelling-partitions")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _next_letter(rows: DataFrame) -> DataFrame:
    """Pairs of a partition whose edit is at the first letter behind the shared part."""
    deep, length = F.char_length("shared"), F.char_length("word")
    rest = F.when(F.col("back"), F.substring("word", F.lit(1), length - deep)).otherwise(F.substring("word", deep + 1, length))
    rows = rows.withColumn("rest", rest)
    less = F.when(F.col("back"), F.substring("rest", F.lit(1), F.char_length("rest") - 1)).otherwise(F.substring("rest", F.lit(2), F.char_length("rest")))
    kept = rows.select("back", "size", "shared", "word", "n", F.col("rest").alias("left"), F.lit(False).alias("cut"))
    cut = rows.where(F.char_length("rest") > 0).select("back", "size", "shared", "word", "n", less.alias("left"), F.lit(True).alias("cut"))

    def run(table: pa.Table) -> pa.Table:
        held = list(zip(*[table.column(c).to_pylist() for c in ("word", "n", "cut")], strict=True))
        pairs = [(w, v, m) for w, _, a in held for v, m, b in held if w != v and (a or b)]
        return pa.Table.from_batches([_near_rows(pairs)])

    return kept.union(cut).groupBy("back", "size", "shared", "left").applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by doubling. Forms have no cycles."""
    now = written(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(lookup_by_key(now, step, ["root"]).select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point. ``form`` is the near word of largest n (ties: the
    smallest in code-point order) if its n is ``times`` the word's or more, else
    null; ``root`` follows forms to the last. The number of near words is
    bounded by a word's length and the letters there are.

    Words are distinct and not null. An empty vocabulary gives no rows.
    """
    words = written(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    forms = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST, occurrences: int = 5, times: int = 5, drop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of whole texts: runs of Latin letters of ``least`` code points or more with ``occurrences`` or more.

    Occurrences are added up in the tasks before they are shuffled, so a very
    common word is one row of each. Null and empty texts have no words; repeated
    rows count again; an empty table gives no rows. A null id is the word ``null`` in the
    seed of ``drop`` (see ``word_counts``).
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return variants(word_counts(source, least, drop).where(F.col("n") >= occurrences), times)
