"""Byte-level BPE: recursive DuckDB queries encode a partition's words, ordered aggregation decodes its ids."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import slices, worker_state
from docmill.llm.segments import SegmentCache, cut_parts

#: Words of more bytes are merged by a heap: the recursive query has a row for each byte and step.
LONG_WORD = 256
#: What one recursive query encodes at most: the sum of its words' squared bytes, as a word of n bytes has up to n * n / 2 rows.
ROWS_A_QUERY = 1_000_000
#: Parts of texts that a worker remembers at most.
PARTS = 400_000

#: One row a token: key = word * 4096 + byte position, id. Each step joins the
#: neighbouring pairs with the merge table and contracts every word's leftmost
#: pair of minimum rank; a word without such a pair leaves with step -1.
ENCODE = """
WITH RECURSIVE tokens(step, k, id) AS (
  SELECT 0, k, id FROM word_bytes
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT n.k, n.before, n.id, n.step, m.rank
     FROM (SELECT step, k, id, lead(id) OVER v AS next_id, lead(k) OVER v AS next_k, lag(k) OVER v AS before
           FROM tokens WHERE step >= 0 WINDOW v AS (ORDER BY k)) n
     LEFT JOIN merges m ON m.left_id = n.id AND m.right_id = n.next_id AND (n.next_k >> 12) = (n.k >> 12)),
   best AS (SELECT k >> 12 AS word, min((rank::BIGINT << 12) | (k & 4095)) AS b FROM pairs WHERE rank IS NOT NULL GROUP BY 1)
   SELECT CASE WHEN b IS NULL THEN -1 ELSE step + 1 END, k, CASE WHEN (k & 4095) = (b & 4095) THEN (b >> 12)::INT ELSE id END
   FROM pairs LEFT JOIN best ON word = (k >> 12)
   WHERE b IS NULL OR before IS NULL OR before <> ((word << 12) | (b & 4095)))
)
SELECT k, id FROM tokens WHERE step = -1 ORDER BY k
"""

#: The bytes of each document's ids, put together in the order of their positions.
DECODE = """
SELECT doc, string_agg(hex, '') AS hex FROM (
  SELECT doc, pos, hex FROM token_ids JOIN vocabulary USING (id) ORDER BY pos
) GROUP BY doc
"""


class ByteBpe:
    """Encodes and decodes by a rank file; one DuckDB connection for each Python worker."""

    def __init__(self, rank_file: str, pattern: str):
        import duckdb
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": True})
        merges = [(self.ranks[w[:i]], self.ranks[w[i:]], r) for w, r in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        self._table("merges", left_id=[m[0] for m in merges], right_id=[m[1] for m in merges], rank=[m[2] for m in merges])
        self._table("vocabulary", id=list(self.ranks.values()), hex=[w.hex() for w in self.ranks])
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache = SegmentCache(self.encode_parts, PARTS)

    def _table(self, name: str, **columns: list) -> None:
        data = pa.table({k: pa.array(v, pa.string() if k == "hex" else pa.int32()) for k, v in columns.items()})
        self.db.register("data_", data)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM data_")
        self.db.unregister("data_")

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by the recursive query; words of about one length at a time, as each step costs something however few words are left."""
        out: list[np.ndarray] = [None] * len(words)
        short = [i for i, w in enumerate(words) if 1 < len(w) <= LONG_WORD and w not in self.ranks]
        short.sort(key=lambda i: len(words[i]))
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = np.array([self.ranks[w]], np.uint32)
            elif len(w) > LONG_WORD:
                out[i] = self._merge_long(w)
        place = np.cumsum([len(words[i]) ** 2 for i in short], dtype=np.int64) // ROWS_A_QUERY
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(short)]
        for lo, hi in zip(cuts, cuts[1:]):
            block = short[lo:hi]
            if not block:
                continue
            n = np.array([len(words[i]) for i in block])
            word = np.repeat(np.arange(len(block), dtype=np.int64), n)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in block), np.uint8)]
            self.db.register("word_bytes", pa.table({"k": (word << 12) | pos, "id": ids}))
            got = self.db.execute(ENCODE).fetchnumpy()
            self.db.unregister("word_bytes")
            ends = np.searchsorted(got["k"] >> 12, np.arange(1, len(block)))
            for i, x in zip(block, np.split(np.asarray(got["id"]).astype(np.uint32), ends)):
                out[i] = x
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same contraction for one long word, by a heap of (rank, position) and linked neighbours."""
        parts = [word[i : i + 1] for i in range(len(word))]
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap = [(r, i) for i in range(len(word) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= len(parts) or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
                if (x := self.ranks.get(parts[i] + parts[right[j]])) is not None:
                    heapq.heappush(heap, (x, i))
            if left[i] >= 0 and (x := self.ranks.get(parts[left[i]] + parts[i])) is not None:
                heapq.heappush(heap, (x, left[i]))
        return np.array([self.ranks[p] for p in parts if p is not None], np.uint32)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as bytes: its matches of the pattern, each distinct one encoded once."""
        matches = [self.pattern.findall(s) for s in parts]
        words = list(dict.fromkeys(chain.from_iterable(matches)))
        known = dict(zip(words, (x.tobytes() for x in self.encode_words([w.encode() for w in words]))))
        return [known[ms[0]] if len(ms) == 1 else b"".join(map(known.__getitem__, ms)) for ms in matches]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the texts' bounds in it.

        A text is cut before spaces that no other white space is next to, and
        between letters, digits and punctuation. No match of the pattern crosses
        such a place: a space only begins a match, and but for a contraction,
        whose apostrophe keeps its segment whole, a match is of one kind.
        """
        index, parts, bounds = cut_parts(texts, spaces=True)
        return self.cache.gather(self.cache.slots(parts)[index], bounds)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids."""
        out = [b""] * (len(bounds) - 1)
        doc = np.repeat(np.arange(len(out), dtype=np.int32), np.diff(bounds))
        self.db.register("token_ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)}))
        for i, x in self.db.execute(DECODE).fetchall():
            out[i] = bytes.fromhex(x)
        self.db.unregister("token_ids")
        return out


def encode_column(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)``: the ids of every whole text (little-endian unsigned 32-bit) and the bytes they decode to.

    One narrow pass without a shuffle. A null text is the empty one: no ids, no
    bytes. Repeated rows give repeated results; other columns are not read.
    Memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (rank_file, pattern)
        c = worker_state(key, lambda: ByteBpe(*key))
        for b in slices(batches, "t", 1_000_000, keep=key):
            ids, bounds = c.encode(pc.fill_null(b.column(1), ""))
            parts = [ids[lo:hi].astype("<u4").tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch([b.column(0), pa.array(parts, pa.binary()), pa.array(c.decode(ids, bounds), pa.binary())], ["i", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, ids binary, decoded binary").withColumnRenamed("i", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 digests of what encode_column returns, by Spark's own functions."""
    return coded.select(id_col, F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


