"""Hashes of all words and word windows of many texts at once, without a Python object a word.

Word boundaries come from a table of the white-space bytes. A word's hash is a polynomial in its
bytes modulo 2^64, taken as a difference of running sums over the whole buffer, then mixed; a
window's hash is the same over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A number a byte, and the same with A-Z taken as a-z."""
    with np.errstate(over="ignore"):
        plain = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    return plain, lower


PLAIN, LOWER = _byte_values()


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(0, U64), np.ones(0, U64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            found = []
            for factor in (self.base, pow(self.base, -1, 1 << 64)):
                grown = np.full(size, U64(factor))
                grown[0] = 1
                found.append(np.multiply.accumulate(grown))
            self.up, self.down = found
        return self.up, self.down


BYTE_POWERS = Powers(0xD6E8FEB86659FD93)
WINDOW_POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F))


def hash_words(data: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid one after another, and each text's first word.

    ``ends`` are the texts' starts and the last one's end. A text above CHUNK_BYTES is taken in
    pieces that end at white space.
    """
    n = len(data)
    if n > 2 * CHUNK_BYTES and len(ends) == 2:
        found, at = [], 0
        while at < n:
            stop = min(at + CHUNK_BYTES, n)
            if stop < n:
                gaps = np.flatnonzero(SPACE[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:  # one word beyond the piece: go on to its end
                    ahead = stop
                    while ahead < n and not SPACE[data[ahead : ahead + CHUNK_BYTES]].any():
                        ahead += CHUNK_BYTES
                    stop = min(n, ahead + int(np.argmax(SPACE[data[ahead : ahead + CHUNK_BYTES]])) + 1) if ahead < n else n
            found.append(hash_words(data[at:stop], np.array([0, 0, stop - at]), values)[0])
            at = stop
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])
    if not n:
        return np.zeros(0, U64), np.zeros(len(ends), np.int64)
    space = SPACE[data]
    start, stop = ~space, ~space
    start[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    inner = ends[(ends > 0) & (ends < n)]
    start[inner] = ~space[inner]
    stop[inner - 1] = ~space[inner - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = BYTE_POWERS.reach(n)
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * up[:n], out=sums[1:])
        hashes = mix((sums[b] - sums[a]) * down[a])
    return hashes, np.searchsorted(a, ends)


@dataclass(frozen=True)
class Hashed:
    """Words of the texts ``at`` to ``at + count`` of a batch; ``first`` has a text's word range."""

    at: int
    count: int
    hashes: np.ndarray
    first: np.ndarray

    def windows(self, size: int, both: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """One or two hashes of every window that lies in one text, and the word it starts at."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
        room = np.maximum(np.diff(self.first) - size + 1, 0)
        before = np.cumsum(room) - room
        starts = np.repeat(self.first[:-1] - before, room) + np.arange(int(room.sum()))
        found, words = [], self.hashes
        for powers in WINDOW_POWERS[: 2 if both else 1]:
            up, down = powers.reach(n + size)
            sums = np.zeros(n + 1, U64)
            with np.errstate(over="ignore"):
                np.cumsum(words * down[:n], out=sums[1:])
                found.append(mix((sums[starts + size] - sums[starts]) * up[starts + size - 1]))
                words = mix(words + U64(1))
        return found[0], found[1] if both else None, starts

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text (counted from ``at``) that each word belongs to."""
        return np.searchsorted(self.first, words, "right") - 1


def hashed_texts(column: pa.Array, lower: bool = False) -> Iterator[Hashed]:
    """The texts of a column in runs of about CHUNK_BYTES; a null text has no words."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(filled)
    if not n:
        return
    _, offsets, body = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    values = LOWER if lower else PLAIN
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, n)
        hashes, first = hash_words(data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at], values)
        yield Hashed(at, stop - at, hashes, first)
        at = stop
