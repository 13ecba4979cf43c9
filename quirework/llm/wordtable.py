"""Bounded memory of words that a worker has seen, exact by their bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textops import _KEEP, LONG_BYTES, byte_hashes, eights, mix64


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` entries at least."""
    if len(a) >= n:
        return a
    out = np.zeros(max(n, len(a) + len(a) // 2), a.dtype)
    out[: len(a)] = a
    return out


class NumberTable:
    """Open-addressing table from non-zero 64-bit numbers to entries, for whole arrays at once. ``spread``: the numbers aren't hashes."""

    def __init__(self, slots: int = 1 << 16, spread: bool = False):
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.n, self.spread = 0, spread

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each number, or of the free place where its search ends."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (mix64(keys) if self.spread else keys) & mask
        seen = self.keys[slot]
        at = np.flatnonzero((seen != keys) & (seen != 0))
        while len(at):
            slot[at] = (slot[at] + np.uint64(1)) & mask
            seen = self.keys[slot[at]]
            at = at[(seen != keys[at]) & (seen != 0)]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each number, -1 where it is unknown."""
        slot = self._slots(keys)
        return np.where(self.keys[slot] == keys, self.entry[slot], -1)

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        while len(keys):
            slot = self._slots(keys)
            _, won = np.unique(slot, return_index=True)
            self.keys[slot[won]], self.entry[slot[won]] = keys[won], entries[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, entries = keys[lost], entries[lost]

    def add(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Distinct numbers that the table doesn't hold."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old, entry = self.keys[self.keys != 0], self.entry[self.keys != 0]
            slots = 1 << (2 * self.n).bit_length()
            self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._put(old, entry)
        self._put(keys, entries)


class WordTable:
    """Numbers words 0, 1, ..., looked up for whole arrays at once.

    A table of 64-bit hashes leads to an entry, and the entry's own bytes must agree, eight at a time.
    Words that are long, or whose hash belongs to another word, are in a dictionary by their bytes.
    """

    def __init__(self, slots: int = 1 << 16):
        self.hashes = NumberTable(slots)
        self.pool, self.begin = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)
        self.other: dict[bytes, int] = {}
        self.n = 0

    def _agree(self, entry: np.ndarray, view: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the entries' bytes are those at ``starts``."""
        begin = self.begin[entry]
        own = eights_of(self.pool)
        same = self.begin[entry + 1] - begin == size
        part = _KEEP[np.minimum(size, 8)]
        same &= (own[begin] & part) == (view[starts] & part)
        more, done = np.flatnonzero(same & (size > 8)), 8
        while len(more):
            part = _KEEP[np.minimum(size[more] - done, 8)]
            ok = (own[begin[more] + done] & part) == (view[starts[more] + done] & part)
            same[more[~ok]] = False
            done += 8
            more = more[ok & (size[more] > done)]
        return same

    def _store(self, sizes: np.ndarray) -> int:
        """Room in the pool for new entries of these sizes; where it begins."""
        at = int(self.begin[self.n])
        self.begin = grown(self.begin, self.n + len(sizes) + 1)
        self.begin[self.n + 1 : self.n + len(sizes) + 1] = at + np.cumsum(sizes)
        self.n += len(sizes)
        # Eight more, so that the last entry can be read in eights.
        self.pool = grown(self.pool, int(self.begin[self.n]) + 8)
        return at

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """Entry of each word ``data[s:e]``. ``learn`` gets the words that are new, in the order of their entries."""
        view, size = eights(data), ends - starts
        keys = byte_hashes(data, starts, ends, view) | np.uint64(1)
        out = self.hashes.find(keys)
        long = size > LONG_BYTES
        there = np.flatnonzero((out >= 0) & ~long)
        out[there[~self._agree(out[there], view, starts[there], size[there])]] = -2
        out[long] = -2
        fresh = np.flatnonzero(out == -1)
        if not len(fresh) and not (out == -2).any():
            return out
        raw, words = data.tobytes(), []
        if len(fresh):
            new, at, group = np.unique(keys[fresh], return_index=True, return_inverse=True)
            first = fresh[at]
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            numbers = np.arange(self.n, self.n + len(new))
            place = self._store(size[first])
            text = np.frombuffer(b"".join(words), np.uint8)
            self.pool[place : place + len(text)] = text
            self.hashes.add(new, numbers)
            out[fresh] = numbers[group]
            out[fresh[~self._agree(out[fresh], view, starts[fresh], size[fresh])]] = -2
        for k in np.flatnonzero(out == -2).tolist():
            word = raw[starts[k] : ends[k]]
            number = self.other.get(word)
            if number is None:
                number = self.other[word] = self.n
                self._store(np.zeros(1, np.int64))
                words.append(word)
            out[k] = number
        if words:
            learn(words)
        return out


def eights_of(pool: np.ndarray) -> np.ndarray:
    """As ``eights``, of a buffer whose last eight bytes are spare: no copy."""
    return np.ndarray((len(pool) - 7,), "<u8", pool, 0, (1,))
