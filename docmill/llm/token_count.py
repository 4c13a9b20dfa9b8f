"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where that is proven exact."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import slices, worker_state

#: What stands for a space inside the pieces.
SPACE = "▁"


class Splicer:
    """Encodes texts with a SentencePiece BPE model; a long one is cut in overlapping chunks.

    Two chunks' encodings are joined at a *stable common boundary*: an offset
    at which both have a token boundary and which no merge can cross, whatever
    stands around it. Merges only make pieces of the vocabulary, so an offset
    between characters a and b is such a barrier if no piece holds ``ab``. Left
    of it the left chunk has seen all that matters, right of it the right chunk
    has. Where the overlap has none, it is doubled, to the whole rest of the
    text if need be.
    """

    def __init__(self, model: str, chunk: int = 16_384, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Chunks are cut in the raw text, which needs a model that leaves texts as they are.
        self.plain = self.sp.normalize("Ａ  é \t\n x ") in ("Ａ  é \t\n x ", f"{SPACE}Ａ{SPACE}{SPACE}é{SPACE}\t\n{SPACE}x{SPACE}")
        self.bytes = any(self.sp.is_byte(i) for i in range(self.sp.get_piece_size()))
        self.widened = 0

    def barrier(self, text: str, at: int) -> bool:
        """Whether no piece can hold the characters on both sides of the offset."""
        if not self.bytes and text[at] not in (" ", SPACE):  # without byte fallback, unknown neighbours are joined
            return False
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.pairs

    def tokens(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of the text, and the offsets at which each begins and ends."""
        got = self.sp.encode(text, return_type="offset_mapping")
        begins, ends = zip(*got["offsets"]) if got["ids"] else ((), ())
        return list(got["ids"]), list(begins), list(ends)

    def common(self, text: str, left: tuple, right: tuple, r0: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """The first stable common boundary in (lo, hi): its offset and the number of tokens before it on either side."""
        (_, b1, e1), (_, b2, e2) = left, right
        for j in range(bisect_left(b2, lo + 1 - r0), len(b2)):
            at = b2[j] + r0
            if at >= hi:
                return None
            j0 = bisect_left(b2, at - r0)
            i = bisect_left(b1, at)
            if j0 and i and i < len(b1) and b1[i] == at and e1[i - 1] <= at and e2[j0 - 1] + r0 <= at and self.barrier(text, at):
                return at, i, j0
        return None

    def encode(self, text: str) -> list[int]:
        """The ids of the text, as the library gives them for the whole of it."""
        if len(text) <= self.chunk or not self.plain:
            return list(self.sp.encode(text))
        out: list[int] = []
        r0, at, skip, overlap = 0, 0, 0, self.overlap  # the chunk starts at r0; its first skip tokens are left of the boundary at
        while True:
            stop = min(len(text), at + self.chunk + overlap)
            ids, begins, ends = self.tokens(text[r0:stop])
            if stop == len(text):
                return out + ids[skip:]
            next0 = stop - overlap
            left = (ids, [b + r0 for b in begins], [e + r0 for e in ends])
            found = self.common(text, left, self.tokens(text[next0 : min(len(text), stop + overlap)]), next0, next0, stop)
            if found is None:  # alignment fails: a wider overlap
                overlap *= 2
                self.widened += 1
                continue
            out += ids[skip : found[1]]
            r0, (at, _, skip), overlap = next0, found, self.overlap


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """Bytes and tokens of every whole text: ``(id, n_bytes, n_tokens, n_chunks)``; one narrow pass, no shuffle.

    A null text counts as the empty one (0 bytes, 0 tokens). Repeated rows give
    repeated results; other columns of docs are not read. Texts of any length
    are counted whole; memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, chunk, overlap)
        s = worker_state(key, lambda: Splicer(*key))
        for b in slices(batches, "t", keep=key):
            texts = pc.fill_null(b.column(1), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            texts = texts.to_pylist()
            n = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= s.chunk]
            for i, ids in zip(short, s.sp.encode([texts[i] for i in short], num_threads=1, return_type="numpy")):
                n[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > s.chunk:
                    n[i] = len(s.encode(t))
            yield pa.record_batch([b.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([-(-len(t) // s.chunk) for t in texts], pa.int64())], ["i", "n_bytes", "n_tokens", "n_chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long, n_chunks long").withColumnRenamed("i", id_col)
