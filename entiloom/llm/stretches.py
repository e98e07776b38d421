"""Encoding each distinct stretch of text once.

A text is cut before every single blank between two other characters, and between an ASCII letter and an ASCII mark
other than the apostrophe. Pre-tokenizers that part letters from marks, and drop white space or let a blank open the
next word, never join what such a cut parts, so the ids of a text are those of its stretches one after another. Cuts, hashes and look-ups of a whole batch are numpy operations on its bytes; a found stretch counts
only if its bytes are equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: White space beyond the ASCII blanks: texts with it are encoded whole.
ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MOST = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, items: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + size[i]] of all items, one after another."""
    n = size[items]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[items] - ends + n, n)]


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, for hashes of substrings from running sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> Powers:
        if len(self.up) < n:
            one = np.full(max(n, 1 << 16), _BASE, np.uint64)
            one[0] = 1
            self.up = np.multiply.accumulate(one)
            one[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(one)
        return self


POWERS = Powers()


class Pool:
    """An array that grows at its end; `all` is what it holds."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : end] = more
        self.n = end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Stretches:
    """encode: texts -> (ids of all one after another, ids of each). At most about MOST stretches are remembered.
    fold: the vocabulary lower-cases, so A-Z may be lower-cased beforehand. Texts that hold one of `whole` (the
    vocabulary's added tokens, or what opens them) are encoded whole."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fold: bool = False, whole: tuple[str, ...] = ()):
        self.new, self.fold, self.marks = encode, fold, whole
        self.clear()

    def clear(self):
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)  # in the order of keys
        self.raw, self.raw_at, self.raw_size = Pool(np.uint8), Pool(np.int64), Pool(np.int64)
        self.ids, self.ids_at, self.ids_size = Pool(np.int32), Pool(np.int64), Pool(np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        ids, size = self.new(texts)
        return np.split(ids, np.cumsum(size)[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        out: list = [None] * len(texts)
        odd = [i for i, x in enumerate(texts) if ODD_BLANKS.search(x) or any(m in x for m in self.marks)]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        plain = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(plain, self.cached([texts[i].encode() for i in plain]) if plain else [], strict=True):
            out[i] = ids
        return out

    def cached(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.keys) > MOST:
            self.clear()
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        if self.fold:
            raw = _LOWER[raw]
            data = raw.tobytes()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = np.cumsum(size) - size
        if not len(raw):
            return [np.empty(0, np.int32)] * len(texts)
        cut = np.zeros(len(raw), bool)
        solid = _SOLID[raw]
        cut[1:-1] = (raw[1:-1] == 32) & solid[:-2] & solid[2:]
        cut[1:] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
        full = size > 0
        last = (text_at + size - 1)[full]
        cut[last[raw[last] == 32]] = False  # what follows a text's last blank is another text
        cut[text_at[full]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.r_[start, len(raw)])
        p = POWERS.reach(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p.up[: len(raw)], out=total[1:])
        h = (total[start + length] - total[start]) * p.down[start]
        key, first, code = np.unique(h ^ (h >> np.uint64(32)), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        lacks = np.ones(len(key), bool)
        if len(self.keys):
            lacks = self.keys[np.minimum(at, len(self.keys) - 1)] != key
        if lacks.any():
            self.learn(data, raw, key[lacks], at[lacks], start[first[lacks]], length[first[lacks]])
        slot = self.slot[np.searchsorted(self.keys, key)][code]
        if not np.array_equal(self.raw_size.all[slot], length) or not np.array_equal(gather(self.raw.all, self.raw_at.all, self.raw_size.all, slot), raw):
            return self.whole([x.decode() for x in texts])  # two stretches of one hash
        ids = gather(self.ids.all, self.ids_at.all, self.ids_size.all, slot)
        n = np.add.reduceat(np.r_[self.ids_size.all[slot], 0], np.searchsorted(start, text_at)) * (size > 0)
        return np.split(ids, np.cumsum(n)[:-1])

    def learn(self, data: bytes, raw: np.ndarray, key: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        ids, size = self.new([data[a : a + n].decode() for a, n in zip(start.tolist(), length.tolist(), strict=True)])
        slot = len(self.slot) + np.arange(len(key))
        self.raw_at.add(self.raw.n + np.cumsum(length) - length)
        self.raw_size.add(length)
        self.raw.add(gather(raw, start, length, np.arange(len(start))))
        self.ids_at.add(self.ids.n + np.cumsum(size) - size)
        self.ids_size.add(size)
        self.ids.add(ids)
        self.keys, self.slot = np.insert(self.keys, at, key), np.insert(self.slot, at, slot)
