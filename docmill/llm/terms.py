"""Terms of whole texts by classes of bytes, found and counted over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once: longer batches go in pieces, cut where no term is.
PIECE = 1 << 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_bytes(digits: bool) -> np.ndarray:
    """Which bytes belong to a term: Latin letters, all of characters beyond ASCII, and digits if asked for."""
    inside = np.zeros(256, bool)
    inside[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    if digits:
        inside[48:58] = True
    return inside


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (no nulls), and where each begins."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(a: np.ndarray, inside: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(a):
        hi = min(len(a), lo + piece)
        while hi < len(a) and inside[a[hi]] and inside[a[hi - 1]]:
            gaps = np.flatnonzero(~inside[a[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(len(a), hi + piece)
        yield lo, hi
        lo = hi


def _found(a: np.ndarray, begins: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where each term begins, and the terms, A to Z lowered; no term goes across one of begins."""
    word = inside[a]
    left = np.concatenate([[False], word[:-1]])
    left[begins] = False
    right = np.concatenate([word[1:], [False]])
    right[begins[begins > 0] - 1] = False
    starts = np.flatnonzero(word & ~left)
    lengths = np.flatnonzero(word & ~right) + 1 - starts
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return starts, pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[a[word]])])


def term_counts(texts: pa.Array, digits: bool, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct terms of each text (no nulls): rows, codes of terms, occurrences, and the terms by code.

    Entries are ordered by row and code. Memory is about twelve times a piece's
    bytes, and the distinct terms.
    """
    a, offsets = _bytes(texts)
    inside = term_bytes(digits)
    got = []
    for lo, hi in _pieces(a, inside, piece):
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        begins = offsets[first:last]
        starts, terms = _found(a[lo:hi], begins[begins >= lo] - lo, inside)
        rows = np.searchsorted(offsets, starts + lo, "right") - 1
        coded = terms.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(coded.dictionary), 1)
        keys, counts = np.unique(rows * n + codes, return_counts=True)
        got.append((keys // n, keys % n, counts.astype(np.int64), coded.dictionary))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    return got[0] if len(got) == 1 else merged(got)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Counts of several parts as those of one: equal terms get one code, and counts of equal rows and terms are added."""
    coded = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum([0] + [len(p[3]) for p in parts])
    n = max(len(coded.dictionary), 1)
    keys = np.concatenate([p[0] * n + codes[f + p[1]] for p, f in zip(parts, first)])
    keys, counts = summed(keys, np.concatenate([p[2] for p in parts]))
    return keys // n, keys % n, counts, coded.dictionary


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values[order], at) if len(at) else values[:0]
