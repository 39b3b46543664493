"""Numpy helpers for tasks: hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

PIECE, LONG = 1 << 16, 256
_STEP = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(PIECE + LONG - 1, _BASE, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, pow(_BASE, -1, 2**64), np.uint64)])
_CODES = np.random.default_rng(20240502).integers(1, 2**64, 256, np.uint64)
_LOWER_CODES = _CODES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text, lower: bool = False) -> np.ndarray:
    """64-bit hashes of a UTF-8 text's words between ASCII blanks, A-Z lower-cased if wished.

    A word's hash is a polynomial in random codes of its bytes, taken from running
    sums over ``PIECE`` bytes at a time; words beyond ``LONG`` bytes are hashed singly.
    """
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    codes = _LOWER_CODES if lower else _CODES
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(raw), PIECE):
        a, b = np.searchsorted(starts, (at, at + PIECE))
        part = codes[raw[at:at + PIECE + LONG]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[:len(part)], out=sums[1:])
        s, e = starts[a:b] - at, np.minimum(ends[a:b] - at, len(part))
        out[a:b] = mixed((sums[e] - sums[s]) * _INVERSES[s])
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = raw[starts[k]:ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words (none if there are fewer), by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, at = None, 0, words, 1, size
    step = np.uint64(_STEP)
    while at:
        if at & 1:
            part = block[done:done + n]
            out = part if out is None else mixed(out * step + part)
            done += width
        at >>= 1
        if at:
            block = mixed(block[:-width] * step + block[width:])
            width *= 2
    return mixed(out + np.uint64(size))
