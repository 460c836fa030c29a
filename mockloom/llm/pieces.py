"""Ids of the pieces of a tokenizer's splitting pattern, each encoded by the library when first met and then remembered."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from mockloom.llm.split import Splitter

#: Longest piece that is told apart by two integers; longer ones are rare and kept by their bytes.
SHORT = 15
#: Pieces one worker remembers, short and long ones.
KEPT_SHORT, KEPT_LONG = 1_200_000, 50_000
#: Pieces that the library encodes as one text.
JOINED = 2000
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


class Table:
    """Open-addressed table from pieces of up to SHORT bytes, as two integers, to runs of ids.

    Pieces that were not met again make room for others when there are too many.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self._make(10)

    def _make(self, bits: int) -> None:
        self.bits, self.filled = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.count = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)
        self.met = np.zeros(1 << bits, bool)
        self.ids, self.used = np.zeros(2 << bits, np.int32), 0

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each piece, or the free one where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((((low * _MIX[0]) ^ (high * _MIX[1])) * _MIX[2]) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.high[at]
        off = np.flatnonzero((held != 0) & ((held != high) | (self.low[at] != low)))
        while len(off):
            at[off] = (at[off] + 1) & mask
            held = self.high[at[off]]
            off = off[(held != 0) & ((held != high[off]) | (self.low[at[off]] != low[off]))]
        return at

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Distinct pieces that are not there yet, and their ids one after the other."""
        while 2 * (self.filled + len(low)) > (1 << self.bits):
            self._moved(np.flatnonzero(self.high), self.bits + 1, True)
        begin = self.used + np.cumsum(count) - count
        if (need := self.used + len(ids)) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), need - len(self.ids)), np.int32))
        self.ids[self.used:need], self.used = ids, need
        left = np.arange(len(low))
        while len(left):
            at = self.place(low[left], high[left])
            _, first = np.unique(at, return_index=True)
            at, now = at[first], left[first]
            self.low[at], self.high[at], self.begin[at], self.count[at] = low[now], high[now], begin[now], count[now]
            left = np.delete(left, first)
        self.filled += len(low)

    def _moved(self, keep: np.ndarray, bits: int, met: bool) -> None:
        """A table of its own size for the slots ``keep``."""
        low, high, count, again = self.low[keep], self.high[keep], self.count[keep], self.met[keep]
        ids = self.ids[np.repeat(self.begin[keep] - (np.cumsum(count, dtype=np.int64) - count), count) + np.arange(int(count.sum(dtype=np.int64)))]
        self._make(bits)
        self.add(low, high, ids, count)
        if met:
            self.met[self.place(low, high)] = again

    def make_room(self) -> None:
        """Of a table with more than ``most`` pieces, keep those met again; none, if that is over half."""
        if self.filled > self.most:
            keep = np.flatnonzero(self.met)
            self._moved(keep if 2 * len(keep) <= self.most else keep[:0], 10, False)


class LibraryEncoder:
    """Ids by the tokenizers library. The library tokenizes each piece of the splitting pattern on its own, so the ids of a
    text are those of its pieces, and a piece met before needs no second encoding."""

    def __init__(self, path: str, kept: int = KEPT_SHORT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = Splitter([(t.content, i) for i, t in self.library.get_added_tokens_decoder().items()])
        self.short = Table(kept)
        self.long: dict[bytes, list[int]] = {}
        line = self.library.encode("\n", add_special_tokens=False).ids
        #: The id between pieces of a joined text; none if a line end is several ids.
        self.between = line[0] if len(line) == 1 else None

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Many go to the library as the lines of one text, as a line end always stands alone between other pieces."""
        texts = [p.decode() for p in pieces]
        joined = self.between is not None
        plain = [joined and not t.isspace() and "\n" not in t and not any(s in t for s in self.special) for t in texts]
        out: list[list[int]] = [[]] * len(texts)
        alone = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(alone, self.library.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = e.ids
        rest = [k for k, p in enumerate(plain) if p]
        for start in range(0, len(rest), JOINED):
            some = rest[start:start + JOINED]
            made, row = self.library.encode_batch_fast(["\n".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, []
            cuts = [-1, *[k for k, i in enumerate(made) if i == self.between], len(made)]
            if len(cuts) != len(some) + 1:  # a line end joined something: encode these one by one
                row = [e.ids for e in self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            for k, ids in zip(some, row or [made[a + 1:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True):
                out[k] = ids
        return out

    def _short(self, words: np.ndarray, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of short pieces; new ones are learnt."""
        low = words[begin] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64))
        more = np.maximum(size - 8, 0)
        high = np.where(more > 0, words[begin + 8] & ((np.uint64(1) << (more * 8).astype(np.uint64)) - np.uint64(1)), np.uint64(0)) | size.astype(np.uint64) << np.uint64(56)
        at = self.short.place(low, high)
        new = np.flatnonzero(self.short.high[at] == 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            one = order[first]
            made = self._encoded([raw[b:b + n] for b, n in zip(begin[one].tolist(), size[one].tolist(), strict=True)])
            count = np.array([len(m) for m in made], np.uint8)
            self.short.add(low[one], high[one], np.array([i for m in made for i in m], np.int32), count)
            at = self.short.place(low, high)
        again = np.ones(len(at), bool)
        again[new] = False
        self.short.met[at[again]] = True
        return at

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of each text."""
        self.short.make_room()
        if len(self.long) > KEPT_LONG:
            self.long.clear()
        begin, _ = self.split(data, bounds)
        raw, end = data.tobytes(), np.append(begin[1:], len(data)) if len(begin) else begin
        size = end - begin
        # the eight bytes from every place on
        words = np.ndarray((len(data) + 16,), "<u8", raw + bytes(24), strides=(1,))
        short = np.flatnonzero(size <= SHORT)
        at = self._short(words, raw, begin[short], size[short])
        count = np.zeros(len(begin), np.int64)
        count[short] = self.short.count[at]
        long_ = np.flatnonzero(size > SHORT)
        pieces = [raw[a:b] for a, b in zip(begin[long_].tolist(), end[long_].tolist(), strict=True)]
        new = list({p for p in pieces if p not in self.long})
        self.long.update(zip(new, self._encoded(new), strict=True))
        made = [self.long[p] for p in pieces]
        count[long_] = [len(m) for m in made]
        until = np.cumsum(count)
        out = np.empty(int(until[-1]) if len(until) else 0, np.int32)
        for places, source, first in (
                (short, self.short.ids, self.short.begin[at]), (long_, np.array([i for m in made for i in m], np.int32), None)):
            n = count[places]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if first is None:
                first = np.cumsum(n) - n
            out[np.repeat(until[places] - n, n) + inside] = source[np.repeat(first, n) + inside]
        text = np.searchsorted(bounds, begin, side="right") - 1
        return out, np.bincount(text, weights=count, minlength=len(bounds) - 1).astype(np.int64)


@lru_cache(maxsize=1)
def library(path: str) -> LibraryEncoder:
    """One for each worker, of the file it used last."""
    return LibraryEncoder(path)
