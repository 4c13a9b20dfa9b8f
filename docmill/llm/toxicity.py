"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding, normalised by length.

Texts are folded: lower case, homoglyphs and digit substitutions to plain
letters, accents and invisible characters off, all but letters to one space.
The lexicon has whole words and word beginnings, each weighted by its log-odds
in labelled texts (seed words have a prior weight), and exception phrases: an
entry with a neighbouring word with which it stands in harmless texts only. A
text's score is a logistic function of the weighted matches (exceptions
cancel theirs), their rate by length, and the length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import cut, sample_labelled, slices

#: Words that count as insults before anything is learned.
SEED = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "pathetic", "worthless", "scum", "trash", "disgusting", "imbecile", "bastard", "bitch", "asshole", "dumbass", "retard", "vermin", "filth")
#: Harmless phrases with such a word.
SEED_EXCEPTIONS = ("trash can", "trash bin", "trash bag", "pond scum", "soap scum")
#: Look-alikes of Latin letters in other scripts, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авеёзикмнорстухіјѕԁһԛԝαβεικνορτυχγω", "abeezukmhopctyxijsdhqwabeiknoptuxyw")) | dict(zip("0134578@$€£ı", "oleastbaseli"))
#: Length of the beginnings of words that may be learned.
BEGINNINGS = range(4, 9)
#: Log-odds below which a word or beginning is not learned.
LEAST_ODDS = 2.5
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_TABLE = str.maketrans(LOOKALIKES) | INVISIBLE | {ord("1"): "i"}
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARKS = re.compile("[̀-ͯ]+")


def fold(text: str) -> str:
    """The folded text, with a space at both ends."""
    text = text.lower().translate(_TABLE)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_TABLE)
    return f" {_NOT_LETTERS.sub(' ', text).strip()} "


@dataclass
class ToxicityModel:
    """Entries (`` word `` or `` begin``) with weights, exception phrases, and the logistic coefficients."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    coefficients: list[float] = field(default_factory=lambda: [-2.0, 1.0, 4.0, 0.0])

    @cached_property
    def automaton(self):
        """The entries' Aho-Corasick automaton."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        a.make_automaton()
        return a

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def hits(self, folded: str) -> Iterator[tuple[float, str, str, str]]:
        """Of each matched word: its weight, the word, the phrase with the word before, and that with the word after."""
        if not self.weights:
            return
        best: dict[int, float] = {}
        for end, (n, w) in self.automaton.iter(folded):
            at = end - n + 1
            if w > best.get(at, -1e9):
                best[at] = w
        for at, w in best.items():
            stop = folded.index(" ", at + 1)
            before = folded.rfind(" ", 0, at) if at else -1
            after = folded.find(" ", stop + 1)
            yield w, folded[at + 1 : stop], folded[before + 1 : stop] if before >= 0 else "", folded[at + 1 : after] if after > 0 else ""

    def features(self, text: str | None) -> list[float]:
        """Constant, weighted matches (log), their rate by length (log), length (log)."""
        folded = fold(text or "")
        counts: Counter = Counter((word, w) for w, word, b, a in self.hits(folded) if b not in self.exceptions and a not in self.exceptions)
        total = sum(w * (1 + math.log(n)) for (_, w), n in counts.items())  # a word said again counts less
        words = folded.count(" ") - 1
        return [1.0, math.log1p(total), math.log1p(100 * total / (words + 10)), math.log1p(words) / 10]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of toxicity of each text."""
        x = np.array([self.features(t) for t in texts]).reshape(-1, 4) @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _unlikely(k: int, n: int, p: float) -> float:
    """Log of a bound on the chance of k or more of n at rate p (Chernoff)."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = 10_000, most_entries: int = 5_000) -> ToxicityModel:
    """Learns the lexicon, the exceptions and the coefficients from labelled rows.

    Training rows are a sample of about per_label of each label (the documented
    bound), each text of an id once. Entries' counts are aggregated before they move; at most
    most_entries, the most unlikely by chance, reach the driver, and of the
    sampled rows three numbers each. Without labels the seed lexicon stands.
    """
    seed = {f" {fold(w).strip()} ": 4.0 for w in SEED}
    keys = sample_labelled(labels.select(key, label), label, [key], per_label)
    joined = docs.select(key, text).join(F.broadcast(keys), key).dropDuplicates([key, text])
    sample = cut(joined.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), "weight"))
    by = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if max(by.values(), default=0) > 2 * per_label:  # ids with many texts
        sample = cut(sample_labelled(sample.drop("weight"), "y", ["t"], per_label))
        by = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by.get(1, 0), by.get(0, 0)
    model = ToxicityModel(dict(seed), frozenset(SEED_EXCEPTIONS))
    if not n1 or not n0:
        return model
    base = n1 / (n1 + n0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            got: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(fold(t or "").split())
                got[y].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if k <= len(w)})
            keys = list(got[0].keys() | got[1].keys())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([got[0][k] for k in keys], pa.int64()), pa.array([got[1][k] for k in keys], pa.int64())], ["e", "d0", "d1"])

    counts = sample.mapInArrow(count, "e string, d0 long, d1 long").groupBy("e").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    odds = F.log((F.col("d1") + 0.5) / (n1 + 1)) - F.log((F.col("d0") + 0.5) / (n0 + 1))
    rare = counts.where(F.col("d1") >= 3).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS)
    found = rare.orderBy(F.desc(F.col("d1") * F.col("odds")), "e").limit(most_entries).collect()
    kept: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r.e), r.e)):
        if _unlikely(r.d1, r.d0 + r.d1, base) > math.log(1e-8):
            continue
        shorter = max((kept[r.e[:k]] for k in range(2, len(r.e)) if r.e[:k] in kept), default=0)
        if r.odds > shorter + 1:
            kept[r.e] = round(r.odds, 4)
    model.weights = {k: w for k, w in seed.items()} | kept

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            got: Counter = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.update({(p, y) for _, _, before, after in model.hits(fold(t or "")) for p in (before, after) if p})
            yield pa.record_batch([pa.array([p for p, _ in got], pa.string()), pa.array([n * (y == 0) for (_, y), n in got.items()], pa.int64()), pa.array([n * (y == 1) for (_, y), n in got.items()], pa.int64())], ["p", "d0", "d1"])

    pairs = sample.mapInArrow(phrases, "p string, d0 long, d1 long").groupBy("p").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    harmless = pairs.where("d0 >= 5 and d1 = 0").orderBy(F.desc("d0"), "p").limit(most_entries).collect()
    model.exceptions = frozenset(SEED_EXCEPTIONS) | {r.p for r in harmless}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            x = np.array([model.features(t) for t in b.column(0).to_pylist()])
            yield pa.record_batch([b.column(1), b.column(2), *(pa.array(x[:, i]) for i in (1, 2, 3))], ["y", "w", "a", "b", "c"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(measure, "y int, w double, a double, b double, c double").collect()])
    model.coefficients = _logistic(np.column_stack([np.ones(len(rows)), rows[:, 2:]]), rows[:, 0], rows[:, 1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Ridge-regularised weighted logistic regression by damped Newton steps."""
    w = w / w.sum() * len(w)
    order = np.lexsort((*x.T, y, w))
    x, y, w = x[order], y[order], w[order]
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * b @ b)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta.tolist()


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text; one narrow pass. A null text is the empty one; repeated rows give repeated results, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            yield pa.record_batch([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["i", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, score double").withColumnRenamed("i", id_col)
