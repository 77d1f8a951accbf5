"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow columns.

Used inside Spark tasks.  A word is a maximal run of word bytes; a document
boundary always ends a word.  Hashes have 64 bits and are equal in every
process, so they can be joined and counted across tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, so that temporary arrays stay small for any text length.
BLOCK = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _word_bytes(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _word_bytes(b" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and everything beyond ASCII.
ALNUM = _word_bytes(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(1 << 16)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ np.uint64((seed * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    h ^= h >> np.uint64(32)
    return h


class Words(NamedTuple):
    """The words of a column, one document after the other."""

    hashes: np.ndarray  # uint64, a word each
    starts: np.ndarray  # byte offset in data
    ends: np.ndarray
    counts: np.ndarray  # words of each document
    first: np.ndarray  # index of each document's first word; one more entry at the end
    data: np.ndarray  # uint8, lower-cased if asked for

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each value's offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(column, word_bytes: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Splits every value of a string column into words and hashes them."""
    data, offsets = column_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = word_bytes[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    opening = inside.copy()
    opening[1:] &= ~inside[:-1] | breaks[1:n]
    closing = inside.copy()
    closing[:-1] &= ~inside[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
        lo, hi = starts[a], ends[b - 1]
        begin = starts[a:b] - lo
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, hi - lo)))
        terms = _POWERS[place & 0xFFFF]
        terms *= (data[lo:hi] + np.uint16(1)) * inside[lo:hi]
        hashes[a:b] = np.add.reduceat(terms, begin)
        a = b
    first = np.searchsorted(starts, offsets)
    return Words(mix(hashes), starts, ends, np.diff(first), first, data)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a document, and the index of each run's first word."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = words.hashes[:n].copy()
    for lo in range(0, n, BLOCK):
        part = acc[lo : lo + BLOCK]
        for j in range(1, size):
            part *= _ROLL
            part += words.hashes[lo + j : lo + j + len(part)]
    at = np.flatnonzero(words.room()[:n] >= size)
    return mix(acc[at], size), at


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values, whatever lies between them (documents' ends are the caller's)."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    power, inverse = _POWERS[: BLOCK], _inverse_powers()
    if size >= BLOCK // 2:
        raise ValueError("runs are too long")
    step = BLOCK - size + 1
    for lo in range(0, max(n, 0), step):
        part = hashes[lo : lo + BLOCK]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)))
        m = len(part) - size + 1
        out[lo : lo + m] = (sums[size:] - sums[:m]) * inverse[:m]
    return out


_inverse: list[np.ndarray] = []


def _inverse_powers() -> np.ndarray:
    if not _inverse:
        out = np.full(BLOCK, pow(int(_MULT), -1, 1 << 64), np.uint64)
        out[0] = 1
        _inverse.append(np.cumprod(out, dtype=np.uint64))
    return _inverse[0]


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of `size` words that starts at one of `at`."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.subtract.at(edges, at + size, 1)
    return np.cumsum(edges[:n]) > 0


def slices(batch, target: int = 1 << 19):
    """A record batch in row ranges of about `target` bytes, so that a task's arrays stay small."""
    size = max(1, batch.num_rows * target // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)
