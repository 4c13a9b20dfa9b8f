"""Token ids as flat binary files: unsigned ids plus 64-bit document offsets, memory-mapped when read.

A data set is a folder with, for each part p, ``ids-p.bin`` (little-endian
unsigned ids, 16 bits where the vocabulary allows, else 32), ``index-p.bin``
(little-endian int64: the key of each document, then n + 1 offsets into the
part's ids) and one ``manifest.json`` with the parts in key order, each with
its number of documents and ids and its base: the ids of all parts before it,
by a prefix sum over the parts.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.llm.common import slices, worker_state
from docmill.llm.segments import SegmentCache, cut_parts

#: What stands for a null key in the index.
NULL_KEY = -(1 << 63)

#: Runs of Latin letters (but for the one whose lower case is two characters), and of punctuation (no apostrophe, no bracket of a special token).
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ž]+|[.,;:!?|*%&$#+=/()\"-]+")
#: Parts of texts that a worker remembers at most.
PARTS = 800_000


class _Words:
    """Encodes parts of texts by the library, plain ones many at a time.

    A run of letters or of punctuation is one match of the pre-tokenizer. A match's last token alone has the end-of-word suffix; so the ids of
    many matches, encoded as one text with spaces between, can be told apart. For
    them the library's normalizer and first split are left out, which then change
    nothing but the case.
    """

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.joins = bool(suffix) and splits_at_spaces(model)
        spec = json.loads(self.library.to_str())
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(spec["pre_tokenizer"] or {}).get("pretokenizers", [])[1:]]}
        self.bare = Tokenizer.from_str(json.dumps(spec)) if self.joins else None
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def each(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the library's results are large, so few at a time."""
        out: list[bytes] = []
        for lo in range(0, len(texts), 4096):
            out += [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
        return out

    def plain(self, words: list[str]) -> list[bytes]:
        """The ids of runs of lower-case letters or of punctuation."""
        out: list[bytes] = []
        for lo in range(0, len(words), 8000):
            block = words[lo : lo + 8000]
            found = self.bare.encode_batch_fast([" ".join(block[k : k + 100]) for k in range(0, len(block), 100)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in found)), np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            assert len(stops) == len(block), "each plain word ends with one end-of-word token"
            flat, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            out += [flat[a:b] for a, b in zip(at, at[1:])]
        return out

    def __call__(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as bytes."""
        if not self.joins:
            return self.each(parts)
        plain = [bool(_PLAIN.fullmatch(s)) for s in parts]
        known = iter(self.plain([s.lower() for s, p in zip(parts, plain) if p]))
        rest = iter(self.each([s for s, p in zip(parts, plain) if not p]))
        return [next(known if p else rest) for p in plain]


def id_type(model: str) -> np.dtype:
    """The unsigned type that holds every id of the model: 16 bits where the vocabulary allows."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if max(Tokenizer.from_file(model).get_vocab().values()) < 1 << 16 else "<u4")


def splits_at_spaces(model: str) -> bool:
    """Whether the tokenizer's ids of a text are those of its space-separated segments, one after the other.

    So it is if white space is only a separator: the pre-tokenizer drops it
    (its matches hold none), and the normalizer's steps (NFC, white space to
    one space, lower case) join nothing across a space. Special tokens hold
    no space and are found within a segment.
    """
    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(model).to_str())
    norm = spec["normalizer"] or {"normalizers": []}
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    return (
        spec["truncation"] is None
        and spec["padding"] is None
        and all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norm.get("normalizers", [norm]))
        and pre.get("type") == "Split"
        and pre["behavior"] == "Removed"
        and pre["invert"]
        and pre["pattern"].get("Regex") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


def encode_documents(docs: DataFrame, model: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` with the ids of every whole text as little-endian bytes of id_type(model), end_id appended; one narrow pass.

    A null text is the empty one, with the end id alone. Repeated rows give
    repeated results, an empty table none; other columns are not read. Memory
    follows the longest text.
    """
    whole, dtype = not splits_at_spaces(model), id_type(model)
    if end_id is not None and end_id > np.iinfo(dtype).max:
        raise ValueError(f"the end id {end_id} does not fit {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(model, lambda: SegmentCache(_Words(model), PARTS))
        tail = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        for b in slices(batches, "t", 2_000_000, keep=model):
            texts = pc.fill_null(b.column(1), "")
            if whole:
                index, segments, bounds = np.arange(len(texts)), texts.to_pylist(), np.arange(len(texts) + 1)
            else:
                index, segments, bounds = cut_parts(texts, spaces=False)
            flat, ends = cache.gather(cache.slots(segments)[index], bounds)
            flat = flat.astype(dtype)
            out = [flat[lo:hi].tobytes() + tail for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["i", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, ids binary").withColumnRenamed("i", id_col)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _put(path: str, write) -> None:
    """Writes a file beside its place and moves it there, so that a repeated or lost task leaves whole files only."""
    fs, at = _store(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        write(f)
    fs.move(own, at)


def write_tokens(encoded: DataFrame, ids: DataFrame, path: str, parts: int, id_col: str = "doc_id", dtype: np.dtype = np.dtype("<u2")) -> dict:
    """Writes ``(id, ids)`` rows in ascending order of the id and returns the manifest.

    The parts are ranges of the id from its quantiles (one scan of ids, the
    table with the id column), the rows move once, ids as bytes. Only the counts of the
    parts reach the driver, which sums them to bases. A part is a stream of
    rows: no task holds more than one document. Rows with a null id come first;
    rows with equal ids stay side by side (their order among each other is that
    of their ids' bytes). A null id is stored as NULL_KEY. dtype is that of the
    encoded ids (id_type of their model).
    """
    fs, at = _store(path)
    fs.create_dir(at, recursive=True)
    cuts = _quantiles(ids, id_col, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lens = [], []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = first.column(0)[0].as_py()

        def copy(f) -> None:
            for b in chain([first], batches):
                for p, key, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                    assert p == part, "a task has one part"
                    keys.append(NULL_KEY if key is None else key)
                    lens.append(len(ids) // dtype.itemsize)
                    f.write(ids)

        _put(f"{path}/ids-{part:06d}.bin", copy)
        index = np.concatenate([np.array(keys, "<i8"), np.concatenate([[0], np.cumsum(lens)]).astype("<i8")])
        _put(f"{path}/index-{part:06d}.bin", lambda f: f.write(index.tobytes()))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sum(lens)], pa.int64())], ["part", "docs", "ids"])

    bucket = F.coalesce(_below(F.col(id_col), cuts), F.lit(0))
    rows = encoded.select(bucket.cast("int").alias("p"), F.col(id_col).alias("k"), "ids")
    rows = rows.repartitionById(len(cuts) + 1, F.col("p")).sortWithinPartitions(F.col("k").asc_nulls_first(), "ids")
    found = sorted((r.part, r.docs, r.ids) for r in rows.mapInArrow(run, "part int, docs long, ids long").collect())
    bases = [0, *accumulate(n for _, _, n in found)]
    manifest = {"dtype": dtype.str, "parts": [{"part": p, "docs": d, "ids": n, "base": base} for (p, d, n), base in zip(found, bases)]}
    _put(f"{path}/manifest.json", lambda f: f.write(json.dumps(manifest).encode()))
    return manifest


def _below(col: Column, cuts: list) -> Column:
    """How many of the ascending cut points lie below the value: a binary search, as one expression."""
    if not cuts:
        return F.lit(0)
    at = F.array(*map(F.lit, cuts))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        right = (s.lo < s.hi) & (F.get(at, mid) < col)
        return F.struct(F.when(right, mid + 1).otherwise(s.lo).alias("lo"), F.when(right | (s.lo >= s.hi), s.hi).otherwise(mid).alias("hi"))

    first = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(col.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), first, step, lambda s: s.lo))


def _quantiles(ids: DataFrame, id_col: str, parts: int) -> list:
    """Up to parts - 1 distinct cut points of the id."""
    if parts < 2:
        return []
    got = ids.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q
    return sorted(set(got or []))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of a written data set, a null id where none was; each task maps its parts' files into memory."""
    fs, at = _store(path)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = np.dtype(manifest["dtype"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, docs, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                index = _mapped(f"{path}/index-{part:06d}.bin", np.dtype("<i8"))
                ids = _mapped(f"{path}/ids-{part:06d}.bin", dtype)
                keys, offsets = index[:docs], index[docs:]
                step = 2_000
                for lo in range(0, docs, step):
                    hi = min(docs, lo + step)
                    o = offsets[lo : hi + 1].tolist()
                    yield pa.record_batch([pa.array(keys[lo:hi], pa.int64(), mask=keys[lo:hi] == NULL_KEY), pa.array(base + offsets[lo:hi], pa.int64()), pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()), pa.array([ids[s:e].tobytes() for s, e in zip(o, o[1:])], pa.binary())], ["id", "start", "n_tokens", "ids"])

    parts = spark.createDataFrame([(p["part"], p["docs"], p["base"]) for p in manifest["parts"]], "part int, docs long, base long")
    return parts.repartitionById(max(1, len(manifest["parts"])), F.col("part")).mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def _mapped(path: str, dtype: np.dtype) -> np.ndarray:
    """The file as an array: memory-mapped where the store has local paths, else read through its own file system."""
    fs, at = _store(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.zeros(0, dtype)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def digest(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4")) for x in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
