"""The heading tree of documents, and its summary and detail chunks.

A document is a tree of sections: section 0 is what stands before the first
heading, and each heading opens one below the nearest heading above it of a
smaller level. Every section gives one summary chunk, its most telling
sentences, and detail chunks of its own text, with the path of headings.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from docmill.functions.chunking import _per_text, chunk_text, headings

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile("[a-z0-9]+")
#: Sentences of a summary.
SENTENCES = 2
SECTION = "section long, parent long, level long, sibling long, title string, path array<string>, text string"
CHUNK = "section long, parent long, path array<string>, kind string, sequence long, text string"


def outline(text: str) -> list[tuple]:
    """Sections in order: number, parent (None for roots), level, place among its siblings from 0, title, headings from the root down, and own text.

    One pass with a stack of open headings. Section 0 has level 0 and no title;
    it is left out if nothing but white space stands there.
    """
    lines = text.split("\n")
    found = headings(text)
    edges = [k for k, _, _ in found] + [len(lines)]
    out, stack, children = [], [], Counter()
    before = "\n".join(lines[: edges[0]])
    if before.strip():
        out.append((0, None, 0, 0, None, [], before))
        children[None] += 1
    for i, (line, level, title) in enumerate(found):
        while stack and stack[-1][1] >= level:
            stack.pop()
        parent = stack[-1][0] if stack else None
        path = [*(t for _, _, t in stack), title]
        out.append((i + 1, parent, level, children[parent], title, path, "\n".join(lines[line + 1 : edges[i + 1]])))
        children[parent] += 1
        stack.append((i + 1, level, title))
    return out


def summary(text: str, n: int = SENTENCES) -> str:
    """The n sentences with the most distinct words that other sentences have too, in their order; the earlier one, if equal."""
    sentences = [s.strip() for s in _SENTENCE.findall(text) if s.strip()]
    words = [set(_WORD.findall(s.lower())) for s in sentences]
    held = Counter(w for x in words for w in x)
    order = sorted(range(len(sentences)), key=lambda i: (-sum(held[w] > 1 for w in words[i]), i))
    return " ".join(sentences[i] for i in sorted(order[:n]))


def section_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, section, parent, level, sibling, title, path, text)`` of every section; one narrow pass. A null or blank text has none."""
    return _per_text(docs, id_col, text_col, SECTION, outline)


def section_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 240, overlap: int = 48) -> DataFrame:
    """``(id, section, parent, path, kind, sequence, text)``: of every section its summary (of it and all sections below) and the details of its own text, each with its path.

    Sections without a word, those below included, have no summary; a summary's sequence is 0.
    """

    def rows(text: str) -> list[tuple]:
        found, parts = outline(text), {}
        for number, parent, *_, own in reversed(found):  # all sections below one come before it
            parts[number] = [own, *parts.get(number, [])]
            if parent is not None:
                parts[parent] = [*parts[number], *parts.get(parent, [])]
        out = []
        for number, parent, _, _, _, path, own in found:
            if told := summary("\n".join(parts[number])):
                out.append((number, parent, path, "summary", 0, told))
            out += [(number, parent, path, "detail", c["sequence"], c["text"]) for c in chunk_text(own, size, overlap)]
        return out

    return _per_text(docs, id_col, text_col, CHUNK, rows)
