"""Vectorised words and hashes over Arrow string buffers.

All functions work on the raw UTF-8 bytes of many documents at once; no Python
object is made for a word. Words are runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA24BAED4963EE407)
#: The first k bytes of eight, little-endian.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer strings are hashed one by one.
LONG_BYTES = 64

#: What operators' tasks keep in a worker for later tasks of the same operator, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The operator's own memory in this worker. A task of another operator forgets it, as workers live on."""
    begin(owner)
    return _KEPT.setdefault(owner, {})


def begin(owner: str) -> None:
    """To be called as an operator's task begins: forgets what tasks of others have left in this worker."""
    others = [name for name in _KEPT if name != owner]
    for name in others:
        del _KEPT[name]
    if others:
        release()


def release() -> None:
    """Gives freed memory back to the system: workers live on for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, zeros after the end: a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of ``data[s:e]`` for each (s, e): eight bytes a round through a bijection that starts from the length.

    Not a polynomial, so no structure of the bytes makes different strings meet; strings over LONG_BYTES go through BLAKE2b.
    """
    view = eights(data) if view is None else view
    size = ends - starts
    h = mix64(size.astype(np.uint64) + _ONE)
    h = mix64(h ^ (view[starts] & _KEEP[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for done in range(8, LONG_BYTES, 8):
        if not len(more):
            return h
        part = view[starts[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]
        h[more] = mix64((h[more] + _TWO) ^ part)
        more = more[size[more] > done + 8]
    if len(more):
        raw = memoryview(np.ascontiguousarray(data))
        h[more] = np.frombuffer(b"".join(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest() for k in more), np.uint64)
    return h


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix64(mix64(a ^ _THREE) + b * _TWO)


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries, by position: of two halves, each of two halves, ..., and of two that overlap for the rest."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, span = hashes, 1
    while 2 * span <= size:
        out, span = _after(out[:-span], out[span:]), 2 * span
    if span < size:
        out = _after(out[:n], out[size - span :])
    return mix64(out[:n] ^ mix64(np.full(1, size, np.uint64)))


@dataclass
class Words:
    """Words of several documents: byte spans, hashes, and each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # document i has words first[i] : first[i + 1]
    hashes: np.ndarray
    data: np.ndarray  # the documents' bytes
    offsets: np.ndarray  # document i has bytes offsets[i] : offsets[i + 1]


def spans_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the documents ``data[offsets[i]:offsets[i+1]]``, and each document's first word.

    ``between`` says of each byte whether it stands between words.
    """
    n = len(data)
    body = ~between[data]
    begin, end = body.copy(), body.copy()
    if n:
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[1:] &= ~body[:-1]
        end[:-1] &= ~body[1:]
        begin[inner] = body[inner]
        end[inner - 1] = body[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """All words of the documents, with their hashes; ``lower`` takes A-Z as a-z."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = spans_of(data, offsets)
    return Words(starts, ends, first, byte_hashes(data, starts, ends), data, offsets)


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of the documents with one space after each, and where each word begins and ends there."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    place = np.arange(int(size.sum()))
    number = np.repeat(np.arange(len(size)), size)
    out[place + number] = words.data[place + np.repeat(words.starts - (starts - np.arange(len(size))), size)]
    return out.tobytes(), starts, ends


def digests(words: Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128 bits (two columns) of the words ``lo`` to ``hi`` - 1 themselves, joined by a space, by BLAKE2b.

    Words hold no space, so different word sequences share a digest only if BLAKE2b collides: no two are known that do.
    """
    text, starts, ends = spaced(words)
    raw, make = memoryview(text), hashlib.blake2b
    out = b"".join([make(raw[a:b], digest_size=16).digest() for a, b in zip(starts[lo].tolist(), ends[hi - 1].tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        raw, kind = column.buffers(), np.int64
    else:
        column = column.cast(pa.string())
        raw, kind = column.buffers(), np.int32
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes; a longer row stands alone."""
    data, offsets = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, and where each document's start.

    A document with 1 to size-1 words has its whole sequence as one shingle; one without words has none.
    """
    first = words.first
    count = np.diff(first)
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(number)))
    out = np.zeros(at[-1], np.uint64)
    full = np.repeat(count >= size, number)
    starts = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], number)
    out[full] = windows_of(words.hashes, size)[starts[full]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            out[at[short]] = windows_of(words.hashes, n)[first[short]]
    return out, at
