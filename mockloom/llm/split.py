"""Where the splitting pattern of byte-level tokenizers begins its pieces, over whole batches in numpy."""

from __future__ import annotations

import numpy as np

from mockloom.llm.bpe import CONTRACTIONS, LETTER, NUMBER, OTHER, SPACE, WHITE

SPECIAL = 5


class Splitter:
    """Piece starts of ``CONTRACTIONS| ?L+| ?N+| ?O+|white(?!nonwhite)|white``.

    Character classes of code points above ASCII are asked of the library when
    first met, so its Unicode tables count and not Python's.
    """

    def __init__(self, special: list[tuple[str, int]]) -> None:
        from tokenizers import pre_tokenizers

        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.special = [(t.encode(), i) for t, i in special]
        self.classes = np.full(0x110000, -1, np.int8)
        self._learn(range(128))

    def _learn(self, points) -> None:
        for p in points:
            c = chr(p)
            kinds = (("a", LETTER), ("1", NUMBER), ("!", OTHER))
            self.classes[p] = SPACE if c == " " else next((k for lead, k in kinds if len(self.pieces(lead + c)) == 1), WHITE)

    def _points(self, data: np.ndarray, lead: np.ndarray) -> np.ndarray:
        first = data[lead].astype(np.int32)
        point = first.copy()
        for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            at = np.flatnonzero(first >= low)
            if not len(at):
                break
            value = first[at] & mask
            for k in range(1, more + 1):
                value = value << 6 | data[np.minimum(lead[at] + k, len(data) - 1)] & 0x3F
            point[at] = value
        return np.minimum(point, 0x10FFFF)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin of each piece in ``data``, and the id of those that are a special token (else -1). Texts lie between ``bounds``."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = self._points(data, lead)
        kind = self.classes[point]
        if (kind < 0).any():
            self._learn(np.unique(point[kind < 0]).tolist())
            kind = self.classes[point]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        found = self._specials(data, bounds)
        for b, e, _ in found:
            first[b] = first[e] = True
        ends = np.append(first[lead[1:]], True)
        first = first[lead]
        for b, e, _ in found:
            kind[np.searchsorted(lead, b):np.searchsorted(lead, e)] = SPECIAL
        white = (kind == SPACE) | (kind == WHITE)
        before = np.empty_like(kind)
        before[0], before[1:] = OTHER, kind[:-1]
        white_before = np.append(False, white[:-1])
        white_after = np.append(white[1:], False)
        start = np.where(white, ~white_before | ~(ends | white_after), np.where(white_before, before != SPACE, kind != before))
        start |= first
        self._contractions(point, kind, before, first, ends, start)
        begin = lead[start]
        ids = np.full(len(begin), -1, np.int64)
        for b, _, i in found:
            ids[np.searchsorted(begin, b)] = i
        return begin, ids

    def _contractions(self, point, kind, before, first, ends, start) -> None:
        mark = np.flatnonzero(point == ord("'"))
        mark = mark[(first[mark] | ((before[mark] != OTHER) & (before[mark] != SPACE))) & ~ends[mark] & (kind[mark] == OTHER)]
        for tail in CONTRACTIONS:
            at = mark
            for k, c in enumerate(tail, 1):
                at = at[~ends[at + k - 1]]
                at = at[point[at + k] == ord(c)]
            start[at + 1] = False
            after = at[~ends[at + len(tail)]] + len(tail) + 1
            start[after[kind[after] == LETTER]] = True

    def _specials(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        raw, out = data.tobytes(), []
        for text, i in self.special:
            at = raw.find(text)
            while at >= 0:
                inside = int(np.searchsorted(bounds, at, side="right"))
                if at + len(text) <= bounds[inside]:
                    out.append((at, at + len(text), i))
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        return sorted(out)
