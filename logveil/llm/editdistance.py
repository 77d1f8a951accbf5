"""Banded bit-parallel edit distance of many pairs of byte strings at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def within(a: list[bytes], b: list[bytes], most: int) -> np.ndarray:
    """For each pair, whether its edit distance in bytes is at most `most` (below 31).

    Each pair keeps the vertical differences of a band of the distance matrix in one
    64-bit word; a step handles one more byte of the shorter string for all pairs.
    The band's top bit follows the diagonal `most` below the main one; past the end
    of the longer string the score moves along its last row.
    """
    n = len(a)
    long = [x if len(x) >= len(y) else y for x, y in zip(a, b, strict=True)]
    short = [y if len(x) >= len(y) else x for x, y in zip(a, b, strict=True)]
    m, k = np.array([len(x) for x in long], np.int64), np.array([len(x) for x in short], np.int64)
    out = np.zeros(n, dtype=bool)
    direct = (m <= most) | (m - k > most)
    out[m <= most] = True
    rows = np.flatnonzero(~direct)
    rows = rows[np.argsort(-k[rows], kind="stable")]
    if not len(rows):
        return out
    pad = 2 * most + 2
    x = np.frombuffer(b"".join(long[r] + b"\0" * pad for r in rows), np.uint8)
    y = np.frombuffer(b"".join(short[r] + b"\0" for r in rows), np.uint8)
    m, k = m[rows], k[rows]
    x0 = np.concatenate(([0], np.cumsum(m + pad)))[:-1]
    y0 = np.concatenate(([0], np.cumsum(k + 1)))[:-1]
    vp = np.full(len(rows), (0xFFFFFFFFFFFFFFFF << (63 - most)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    vn = np.zeros(len(rows), np.uint64)
    score = np.full(len(rows), most, np.int64)
    for i in range(int(k[0])):
        live = int(np.searchsorted(-k, -i, side="left"))  # the pairs whose shorter string has a byte i
        byte, p, v = y[y0[:live] + i], vp[:live], vn[:live]
        match = np.zeros(live, np.uint64)
        for d in range(-most, most + 1):
            at = i + d
            if at < 0:
                continue
            same = (x[x0[:live] + np.minimum(at, m[:live])] == byte) & (at < m[:live])
            match |= same.astype(np.uint64) << np.uint64(63 - (most - d))
        d0 = (((match & p) + p) ^ p) | match | v
        hp, hn = v | ~(d0 | p), d0 & p
        below = i < m[:live] - most
        step = np.where(below, 0, i - (m[:live] - most)).astype(np.uint64)
        row = _ONE << (np.uint64(62) - np.minimum(step, np.uint64(62)))
        score[:live] += np.where(below, (d0 >> np.uint64(63)) == 0, ((hp & row) != 0).astype(np.int64) - ((hn & row) != 0))
        half = d0 >> _ONE
        vp[:live], vn[:live] = hn | ~(half | hp), half & hp
    out[rows] = score <= most
    return out
