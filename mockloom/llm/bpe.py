"""Byte-level BPE compiled to a deterministic transducer, run over whole batches of texts in numpy.

The vocabulary file gives merges in rank order. A tokenization is the one BPE
makes exactly if every two neighbouring tokens are (a merge never reaches over
their seam), so the last token of every prefix is unique and a left-to-right
automaton finds it: a state holds, for each place where a token may still be
open, its node in the vocabulary's trie, the token before it and how many tokens
lie between. Reading a byte moves to the next state and emits the change in the
number of tokens. States are made when first met and kept in an open hash table.
"""

from __future__ import annotations

import json

import numpy as np

#: Contractions of the splitting pattern (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Character classes of the splitting pattern.
OTHER, LETTER, NUMBER, SPACE, WHITE = 0, 1, 2, 3, 4
#: Pieces longer than this are run as several chunks side by side.
CHUNK = 1024
#: Bytes before a chunk from which its entry state is first guessed.
RUN_IN = 48
#: Transitions kept by one worker; beyond it the table starts anew.
MAX_TRANSITIONS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by pair, and the seams each token has at its ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        names = {t for t, _ in self.special}
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in names}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.rank = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            key = (vocab[a], vocab[b])
            self.rank.setdefault(key, r)
            made.setdefault(vocab[a + b], (r, *key))
        self.made = made
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.length = np.ones(max(vocab.values()) + 1, np.int32)
        for t, i in self.ids.items():
            self.length[i] = len(t)
            node = 0
            for b in t:
                child = self.children[node].get(b)
                if child is None:
                    child = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = i
        self._spines: tuple[dict, dict] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens that stood at one end while ``token`` was built: (token, rank that made it, rank that used it up)."""
        known = self._spines[side]
        if token not in known:
            out, used, t = [], float("inf"), token
            while t in self.made:
                rank, left, right = self.made[t]
                out.append((t, rank, used))
                used, t = rank, right if side else left
            out.append((t, -1, used))
            known[token] = out
        return known[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the seam between two neighbouring tokens closed; of equal pairs the left one merges first."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known, rank = True, self.rank
            for x, born_x, used_x in self._spine(left, 1):
                for y, born_y, used_y in self._spine(right, 0):
                    r = rank.get((x, y))
                    if r is not None and born_x < r and born_y < r and r < used_x and r <= used_y:
                        known = False
                        break
                if not known:
                    break
            self._fits[key] = known
        return known


class Transducer:
    """Automaton over the bytes of a piece; transitions emit the change in the number of tokens."""

    def __init__(self, vocabulary: Vocabulary, max_transitions: int = MAX_TRANSITIONS) -> None:
        self.v, self.most = vocabulary, max_transitions
        self._clear()

    def _clear(self) -> None:
        #: A state: ((trie node, token before its start or -1, tokens since its start), ...)
        self.start = ((0, -1, 0),)
        self.number = {self.start: 0}
        self.states = [self.start]
        self.last = np.full(1 << 12, -1, np.int32)
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.emit = np.zeros(1 << self.bits, np.int16)
        self.filled = 0

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        v = self.v
        alive, found, change = [], -1, 0
        for node, before, since in self.states[state]:
            child = v.children[node].get(byte)
            if child is None:
                continue
            token = v.token[child]
            if token >= 0 and found < 0 and (before < 0 or v.fits(before, token)):
                found, change = token, 1 - since
            if v.children[child]:
                alive.append((child, before, since))
        new = (*((n, b, s + change) for n, b, s in alive), (0, found, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            if number >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[number] = found
        return number, change

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or of the free slot where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held != -1))
        while len(off):
            at[off] = (at[off] + 1) & mask
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held != -1)]
        return at

    def _insert(self, keys: np.ndarray) -> None:
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old, to, emit = self.keys, self.to, self.emit
            while 2 * (self.filled + len(keys)) > (1 << self.bits):
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to, self.emit = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)
            self.filled, here = 0, old != -1
            self._place(old[here], to[here], emit[here])
        made = [self._compile(k >> 8, k & 255) for k in keys.tolist()]
        self._place(keys, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))

    def _place(self, keys: np.ndarray, to: np.ndarray, emit: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left])
            _, first = np.unique(at, return_index=True)
            now = left[first]
            self.keys[at[first]], self.to[at[first]], self.emit[at[first]] = keys[now], to[now], emit[now]
            left = np.delete(left, first)
        self.filled += len(keys)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) << 8 | byte
        at = self._slot(keys)
        new = self.keys[at] == -1
        if new.any():
            self._insert(np.unique(keys[new]))
            at = self._slot(keys)
        return self.to[at], self.emit[at]

    def _lanes(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, trace: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All lanes in step: byte k of each, then byte k + 1; lanes leave when they end. Returns end states and emitted counts."""
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], state[order].copy()
        count = np.zeros(len(order), np.int64)
        # lanes are in falling order of length: those with a byte k are a prefix
        ending = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for k, n in enumerate(ending.tolist()):
            to, emit = self.step(state[:n], data[begin[:n] + k])
            state[:n] = to
            count[:n] += emit
            if trace is not None:
                trace[begin[:n] + k] = self.last[to]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, trace: np.ndarray | None = None) -> np.ndarray:
        """Token count of each piece ``data[begin:end]``; ``trace`` gets the last token at every byte.

        Long pieces are cut in chunks. Each chunk is run from the entry state that a
        run-in before it guesses; chunks whose entry differs from where the one before
        left are run again from there, until all agree. At worst, in a piece that never
        synchronises, that is one round for each chunk.
        """
        if self.filled > self.most:
            self._clear()
        parts = np.maximum(1, -(-(end - begin) // CHUNK))
        if parts.max(initial=1) == 1:
            return self._lanes(data, begin, end - begin, np.zeros(len(begin), np.int32), trace)[1]
        piece = np.repeat(np.arange(len(begin)), parts)
        k = np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        b = begin[piece] + k * CHUNK
        e = np.minimum(b + CHUNK, end[piece])
        entry = np.zeros(len(b), np.int32)
        later = np.flatnonzero(k > 0)
        entry[later] = self._lanes(data, b[later] - RUN_IN, np.full(len(later), RUN_IN), np.zeros(len(later), np.int32), None)[0]
        leave, count = self._lanes(data, b, e - b, entry, trace)
        while len(wrong := later[entry[later] != leave[later - 1]]):
            entry[wrong] = leave[wrong - 1]
            leave[wrong], count[wrong] = self._lanes(data, b[wrong], e[wrong] - b[wrong], entry[wrong], trace)
        return np.bincount(piece, weights=count, minlength=len(begin)).astype(np.int64)
