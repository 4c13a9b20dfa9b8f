"""Structure-aware chunking of texts into overlapping windows of words.

A window of at most ``size`` words ends at the last structural break (end of a
paragraph, or of a sentence in a paragraph longer than size) that leaves at
least 65 % of size, if there is one; the next begins ``overlap`` words before
its end. All positions are code points. One narrow Arrow pass: the windows of a
text follow from each other, so they are one function of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Window and overlap in words by file type.
PROFILES = {
    "application/pdf": ("pdf", 200, 40),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("doc", 240, 48),
    "application/msword": ("doc", 240, 48),
    "text/markdown": ("doc", 240, 48),
    "text/plain": ("text", 260, 52),
}
DEFAULT = ("default", 240, 48)
_WORD = re.compile(r"\S+")
_GAP = re.compile(r"\n\s*\n+")
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


def profile(file_type: str | None) -> tuple[str, int, int]:
    """Strategy name, window and overlap of a file type; an overlap not below the window is a quarter of it."""
    name, size, overlap = PROFILES.get((file_type or "").lower(), DEFAULT)
    overlap = overlap if overlap < size else size // 4
    return f"hybrid_structural_{name}_{size}_{overlap}", size, overlap


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every word."""
    return [m.span() for m in _WORD.finditer(text)]


def breaks(text: str, spans: list[tuple[int, int]], size: int) -> list[int]:
    """Ascending word indexes at which a window may end."""
    ends = [e for _, e in spans]
    found = {len(spans)}
    lo = 0
    for gap in [*(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]:
        first, last = bisect_right(ends, lo), bisect_right(ends, gap[0])
        if last > first:
            found.add(last)
            if last - first > size:
                found.update(bisect_right(ends, lo + m.end()) for m in _SENTENCE.finditer(text[lo : gap[0]]))
        lo = gap[1]
    return sorted(b for b in found if 0 < b <= len(spans))


def windows(n: int, marks: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open word windows over n words."""
    out, start, least = [], 0, max(1, int(size * 0.65))
    while start < n:
        end = min(start + size, n)
        at = bisect_right(marks, end) - 1
        if at >= 0 and marks[at] >= start + least:
            end = marks[at]
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else start + max(1, size - overlap)
    return out


def chunk_text(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks with their word and character spans; a blank text has none."""
    spans = word_spans(text)
    chunks = []
    for k, (a, b) in enumerate(windows(len(spans), breaks(text, spans, size), size, overlap)):
        lo, hi = spans[a][0], spans[b - 1][1]
        chunks.append({"sequence": k, "start_token": a, "end_token": b, "start_char": lo, "end_char": hi, "text": text[lo:hi]})
    return chunks


def char_to_word(ends: list[int], position: int) -> int:
    """Words that end at or before the position."""
    return bisect_right(ends, position)


def char_windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Character windows, for texts without words to cut at."""
    step = max(1, size - overlap)
    return [(i, min(len(text), i + size)) for i in range(0, max(1, len(text) - overlap), step)] if text else []


def headings(text: str) -> list[tuple[int, int, str]]:
    """``(line, level, title)``: markdown headings, numbered titles and short lines in capitals."""
    out = []
    for k, line in enumerate(text.split("\n")):
        s = line.strip()
        if m := re.match(r"(#{1,6})\s+(.+)", s):
            out.append((k, len(m[1]), m[2]))
        elif m := re.match(r"(\d+(?:\.\d+)*)\.?\s+(\S.{0,80})$", s):
            out.append((k, m[1].count(".") + 1, m[2]))
        elif s and len(s) <= 80 and s.upper() == s and any(map(str.isalpha, s)) and s[-1] not in ".!?":
            out.append((k, 1, s))
    return out


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that does; each begins with the end of the one before."""
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    parts = list(text) if sep == "" else [p + sep for p in text.split(sep)]
    parts[-1] = parts[-1][: len(parts[-1]) - len(sep)] if sep else parts[-1]
    out, held = [], ""
    for part in parts:
        if len(part) > size:
            for piece in split_recursive(part, size, overlap, separators[k + 1 :] or ("",)):
                if held:
                    out.append(held)
                held = piece
        elif len(held) + len(part) <= size:
            held += part
        else:
            out.append(held)
            tail = held[-overlap:] if overlap else ""
            held = (tail if len(tail) + len(part) <= size else "") + part
    return [*out, held] if held else out


SCHEMA = "sequence int, start_token int, end_token int, start_char int, end_char int, text string"


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 240, overlap: int = 48) -> DataFrame:
    """``(id, sequence, start_token, end_token, start_char, end_char, text)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                rows = [(i, c) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for c in chunk_text(t or "", size, overlap)]
                columns = [pa.array([c[n] for _, c in rows], pa.string() if n == "text" else pa.int32()) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], part.column(0).type), *columns], names=["i", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"i {kind}, {SCHEMA}").withColumnRenamed("i", id_col)


def _per_text(docs: DataFrame, id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    """``(id, *schema)``: the rows (tuples) that a function gives for each text; one narrow Arrow pass."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "array<string>": pa.list_(pa.string())}.get(f.split()[1], pa.int64()) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                found = [(k, r) for k, t in enumerate(part.column(1).to_pylist()) for r in rows(t or "")]
                ids = part.column(0).take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for _, r in found], kind) for i, kind in enumerate(kinds))], names=["i", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"i {kind}, {schema}").withColumnRenamed("i", id_col)


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, start_char, end_char)``: every word of every text, by number, with its code-point offsets."""
    return _per_text(docs, id_col, text_col, "word long, start_char long, end_char long", lambda t: ((k, a, b) for k, (a, b) in enumerate(word_spans(t))))


def words_before(docs: DataFrame, id_col: str, text_col: str, positions) -> DataFrame:
    """``(id, position, word)``: the word index of each position that ``positions(text)`` gives."""

    def rows(text: str):
        ends = [e for _, e in word_spans(text)]
        return ((p, char_to_word(ends, p)) for p in positions(text))

    return _per_text(docs, id_col, text_col, "position long, word long", rows)


def structural_breaks(docs: DataFrame, id_col: str, text_col: str, size: int = 240) -> DataFrame:
    """``(id, at)``: the word indexes at which a window may end."""
    return _per_text(docs, id_col, text_col, "at long", lambda t: ((b,) for b in breaks(t, word_spans(t), size)))


def character_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(id, start_char, end_char)``: overlapping character windows."""
    return _per_text(docs, id_col, text_col, "start_char long, end_char long", lambda t: char_windows(t, size, overlap))


def heading_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line, level, title)``: the headings of every text."""
    return _per_text(docs, id_col, text_col, "line long, level long, title string", headings)


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(id, piece, text)``: every text cut recursively at its coarsest separators."""
    return _per_text(docs, id_col, text_col, "piece long, text string", lambda t: enumerate(split_recursive(t, size, overlap)))
