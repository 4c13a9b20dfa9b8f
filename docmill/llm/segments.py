"""Texts as sequences of parts, each distinct one encoded once per Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class SegmentCache:
    """Token ids of distinct segments in one flat array; encode gets the new ones of a batch at once and gives each one's ids as bytes (32 bits each).

    At most ``most`` segments are kept, so memory is bounded; the cache then
    starts anew, which changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        """Forgets all segments."""
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.used = 0

    def slots(self, segments: list[str]) -> np.ndarray:
        """The slot of each segment, new ones encoded first."""
        at = list(map(self.known.get, segments))
        new = list(dict.fromkeys(s for s, x in zip(segments, at) if x is None))
        if new and len(self.known) + len(new) > self.most:
            self.clear()
            at, new = [None] * len(segments), list(dict.fromkeys(segments))
        if new:
            ids = self.encode(new)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            total = int(n.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat) + 100_000), np.uint32)])
            if total:
                self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
            if base + len(new) > len(self.starts):
                more = np.zeros(max(len(new), len(self.starts) + 100_000), np.int64)
                self.starts, self.lens = np.concatenate([self.starts, more]), np.concatenate([self.lens, more])
            self.starts[base : base + len(new)] = self.used + np.cumsum(n) - n
            self.lens[base : base + len(new)] = n
            self.used += total
            at = [self.known[s] if x is None else x for s, x in zip(segments, at)]
        return np.array(at, np.int64)

    def gather(self, slots: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of slots (row i: bounds[i] to bounds[i + 1]) in one array, and the rows' bounds in it."""
        n = self.lens[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.starts[slots] - ends[:-1], n) + np.arange(ends[-1])
        return self.flat[at], ends[bounds]


#: Classes of bytes. WILD are control characters and what isn't a Latin letter beyond ASCII: white space may be among them.
_WS, _LETTER, _POINT, _DIGIT, _ODD, _WILD, _EDGE = range(7)
_CLASS = np.full(256, _WILD, np.uint8)
_CLASS[0x21:0x7F] = _ODD
_CLASS[[9, 10, 11, 12, 13, 32]] = _WS
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[list(b".,;:!?|*%&$#+=/()\"-")] = _POINT
_CLASS[48:58] = _DIGIT
#: Texts of more characters are worked on in pieces, cut before a space between letters.
LONG = 1 << 23
_GAP = re.compile("[A-Za-z] (?=[A-Za-z])")


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in pieces of about LONG characters at most, and the number of each text's first piece."""
    out, first = [], [0]
    for t in texts.to_pylist():
        lo = 0
        while len(t) - lo > LONG and (m := _GAP.search(t, lo + LONG)):
            out.append(t[lo : m.start() + 1])
            lo = m.start() + 1
        out.append(t[lo:])
        first.append(len(out))
    return pa.array(out, pa.string()), np.array(first)


def cut_parts(texts: pa.Array, spaces: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts (no nulls) cut in parts: index into the distinct parts, those parts, and the rows' bounds.

    A segment stands between spaces that no white space is next to. One that
    holds only Latin letters, digits, common punctuation (no apostrophe, no
    bracket of a special token) and single white space is cut in runs of one
    kind; any other is one part. With ``spaces`` parts keep all bytes: a space
    belongs to the run behind it, other single white space is a part. Without,
    white space is dropped, segments stand between any ASCII white space, those
    with digits stay whole, and capitals A to Z of cut segments are lowered.
    All of it is arithmetic on whole batches of bytes.
    """
    if (pc.max(pc.binary_length(texts)).as_py() or 0) > LONG:
        texts, first = _pieces(texts)
    else:
        first = np.arange(len(texts) + 1)
    none = np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if offsets[0] == offsets[-1]:
        return none, [], np.zeros(len(first), np.int64)
    a = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASS[a]
    before = np.concatenate([a[:1] * 0, a[:-1]])
    latin = ((a & 0xC0) == 0x80) & (before >= 0xC3) & (before <= 0xC5)
    latin &= ~((before == 0xC3) & ((a == 0x97) | (a == 0xB7)) | (before == 0xC4) & (a == 0xB0) | (before == 0xC5) & (a == 0xBF))  # × ÷ İ ſ
    kind[latin] = _LETTER
    begin = np.zeros(len(a), bool)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    left = np.concatenate([[_EDGE], kind[:-1]]).astype(np.uint8)
    left[begin] = _EDGE
    white = kind == _WS
    if spaces:
        right = np.concatenate([kind[1:], [_EDGE]]).astype(np.uint8)
        right[:-1][begin[1:]] = _EDGE
        firm = np.array([k not in (_WS, _WILD, _EDGE) for k in range(7)])
        lone = white & firm[left] & firm[right]
        gap = lone & (a == 32)
        bad = (kind == _ODD) | (kind == _WILD) | (white & ~lone)
        segment = begin | gap
    else:
        bad = kind >= _DIGIT
        segment = ~white & ((left == _WS) | (left == _EDGE))
    at = np.flatnonzero(segment)
    if not len(at):
        return none, [], np.zeros(len(first), np.int64)
    odd = np.zeros(len(a), bool)
    odd[at[0] :] = np.repeat(np.logical_or.reduceat(bad, at), np.diff(np.append(at, len(a))))
    start = (kind != left) & ~odd
    if spaces:
        start[1:] &= ~gap[:-1]
        start |= segment
        at = np.flatnonzero(start)
        ends, data = np.append(at, len(a)), a
    else:
        start = (start & ~white) | segment
        at = np.flatnonzero(start)
        kept = np.cumsum(~white)
        ends = np.append(kept[at] - 1, kept[-1])
        data = np.where((a >= 65) & (a <= 90) & ~odd, a + 32, a).astype(np.uint8)[~white]
    parts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(at, offsets)[first]
