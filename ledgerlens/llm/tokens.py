"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes outside space and tab to carriage return, A-Z lower
cased. Its hash is a polynomial over its bytes modulo 2**64, mixed; two given
words of different spelling share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text k has hashes[offsets[k] : offsets[k + 1]]."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    hashes = np.empty(len(starts), dtype=np.uint64)
    step = 1 << 19  # positions whose powers are held at once
    power, inverse = _powers(_M, step + 1), _powers(_INVERSE, step + 1)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        part = data[base : ends[to - 1]]
        if len(part) > step:  # one very long word
            power, inverse = _powers(_M, len(part) + 1), _powers(_INVERSE, len(part) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_FOLD[part] * power[: len(part)], dtype=np.uint64)])
        a, b = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = (sums[b] - sums[a]) * inverse[a]
        at = to
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return mix(hashes), np.searchsorted(starts, bounds)


def combine(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash for each sequence of word hashes (parts: first words, second words, ...)."""
    out = np.full(len(parts[0]), np.uint64(salt), dtype=np.uint64)
    for p in parts:
        out = out * _M + p
    return mix(out)
