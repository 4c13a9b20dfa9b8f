"""Language identification by string kernels.

The kernel of two texts is that of the blended spectrum: the number of
character n-grams (n = 1 to 4, hashed to a fixed number of bits) present in
both, over the root of the product of their numbers. Landmark texts give the
Nyström approximation; one-versus-rest kernel ridge regression is solved in
it. Texts are scored in batches by matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from docmill.llm.common import cut, sample_labelled, slices

#: Bits of a text's n-gram presence.
BITS = 1 << 15
#: Lengths of the n-grams.
LENGTHS = (1, 2, 3, 4)
#: Rows of a matrix product.
ROWS = 128
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether the text has a letter of any script."""
    return text is not None and any(map(str.isalpha, text))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter; one narrow pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 1_000_000):
            yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def presence(texts: list[str]) -> np.ndarray:
    """One row of BITS zeros and ones for each text: its n-grams of lower-case letters, words between single spaces."""
    out = np.zeros((len(texts), BITS), np.float32)
    for i, t in enumerate(texts):
        c = np.frombuffer(f" {_OTHER.sub(' ', t.lower())} ".encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in LENGTHS:
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[i, (mixed ^ (mixed >> np.uint32(13))) >> np.uint32(17)] = 1
    return out


@dataclass
class LanguageModel:
    """Landmarks' bits (packed), the labels, the Nyström map of landmark kernels to features, and the regression in it."""

    labels: list[str]
    landmarks: np.ndarray
    whiten: np.ndarray | None = None
    coefficients: np.ndarray | None = None

    def dense(self) -> np.ndarray:
        """The landmarks' rows, normalised."""
        x = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def kernel(self, texts: list[str], dense: np.ndarray) -> np.ndarray:
        """Kernel values of texts (rows) and landmarks (columns), by matrix products."""
        out = np.zeros((len(texts), len(dense)))
        for lo in range(0, len(texts), ROWS):
            x = presence(texts[lo : lo + ROWS])
            out[lo : lo + ROWS] = (x @ dense.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1: a short text's features count as much as a long one's."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _windows(text: str, seed: int) -> list[str]:
    """The text, and three short parts of it, from 1 to 12 words, so that short texts are learned too."""
    words = text.split()
    r = np.random.default_rng(seed)
    out = [text]
    for most in (1, 4, 12):
        if len(words) > most:
            at = int(r.integers(0, len(words) - most + 1))
            out.append(" ".join(words[at : at + int(r.integers(1, most + 1))]))
    return out


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_label: int = 800, landmarks: int = 160, ridge: float = 0.3) -> LanguageModel | None:
    """Learns from a sample of about per_label texts of each label (the documented bound); None without labels.

    The landmarks are sampled texts, as many of each label; the executors
    return kernel rows only, a few thousand.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    sample = cut(sample_labelled(rows.select(label, key, text), label, [key, text], per_label).select(F.col(label).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(key).alias("h")))
    labels = sorted(r.y for r in sample.select("y").distinct().collect())
    if not labels:
        return None
    nth = F.row_number().over(Window.partitionBy("y").orderBy("h", F.length("t"), "t"))
    chosen = [r.t for r in sample.withColumn("nth", nth).where(F.col("nth") <= max(2, landmarks // len(labels))).orderBy("y", "nth").collect()]
    bits = np.packbits(presence(chosen).astype(bool), axis=1)
    model = LanguageModel(labels, bits)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for b in slices(batches, "t"):
            texts, ys = [], []
            for y, t, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                for w in _windows(t, h & 0xFFFFFFFF):
                    if has_letter(w):
                        texts.append(w)
                        ys.append(y)
            k = model.kernel(texts, dense)
            yield pa.record_batch([pa.array(ys, pa.string()), pa.array([x.astype("<f8").tobytes() for x in k], pa.binary())], ["y", "k"])

    got = sorted((r.y, bytes(r.k)) for r in sample.mapInArrow(kernels, "y string, k binary").collect())
    if not got:
        return None
    k = np.array([np.frombuffer(x, "<f8") for _, x in got])
    y = np.array([[1.0 if a == b else -1.0 for b in labels] for a, _ in got])
    dense = model.dense().astype(np.float64)
    values, vectors = np.linalg.eigh(dense @ dense.T)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = _unit(k @ whiten)
    n = {a: sum(1 for b, _ in got if b == a) for a in labels}
    w = np.array([1 / n[a] for a, _ in got])[:, None] * len(got) / len(labels)
    beta = np.linalg.solve((x * w).T @ x + ridge * np.eye(x.shape[1]), (x * w).T @ y)
    model.whiten, model.coefficients = whiten, beta
    return model


def tag(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs and, of every whole text, its language and score; one narrow pass, nothing moves.

    A text that is null or has no letter, and any text without a model, is
    ``und`` with score 0. The score is the softmax of the labels' decision
    values, so ties go to the first label in order. Repeated rows give repeated
    results, an empty table none. Columns of docs that are named like a new one
    give way.
    """
    docs = docs.drop(name, score)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense() if model else None
        for b in slices(batches, text_col, 1_000_000):
            texts = b.column(at).to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if model and has_letter(t)]
            if lettered:
                f = _unit(model.kernel([texts[i] for i in lettered], dense) @ model.whiten) @ model.coefficients
                p = np.exp(4 * (f - f.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                for i, j, s in zip(lettered, p.argmax(1).tolist(), p.max(1).tolist()):
                    names[i], scores[i] = model.labels[j], s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*columns, name, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every whole text, as tag gives them; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return tag(rows, model, "_text").select(F.col("_id").alias(id_col), "lang_pred", "score")
