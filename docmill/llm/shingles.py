"""Sets of word n-grams as 64-bit hashes, computed over whole batches of texts."""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(20)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes but space, tab to carriage return; A to Z lowered) and the texts' bounds."""
    a = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_SPACE[a]
    edge = np.diff(word.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _powers(_BASE, len(a)))])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(a))[starts]
    h = mix(h, 1) ^ mix((ends - starts).astype(np.uint64), 2)
    sizes = np.array([len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-grams of words, sorted; with fewer words the whole sequence as one, without words none."""
    h, bounds = word_hashes(texts)
    g = h.copy()
    for k in range(1, n):
        g = mix(g[:-1] * np.uint64(0xD6E8FEB86659FD93), 3) + h[k:] if len(g) > 1 else g[:0]
    g = mix(g, 4)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(g[lo : hi - n + 1]))
        elif hi > lo:
            one = mix(np.array([hi - lo], np.uint64), 5)
            for x in h[lo:hi]:
                one = mix(one * np.uint64(0xD6E8FEB86659FD93), 6) + x
            out.append(mix(one, 7))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that agree for equal sets."""
    if not len(grams):
        return 0, 0
    return tuple(np.array([mix(grams, s).sum(dtype=np.uint64) for s in (8, 9)], np.uint64).view(np.int64).tolist())
