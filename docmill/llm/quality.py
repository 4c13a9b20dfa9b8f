"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence are numbers of the line (how much of it
is letters, capitals, digits, signs; words, repetitions, how it begins and
ends), cut into intervals at quantiles, for the line itself and both its
neighbours; the chain adds a weight for each pair of labels next to each other.
Forward-backward sums give each line's probability of being good; these,
weighted by length, and the share of text in lines that are rather bad make the
document's score by a logistic function.

A document's label is known, those of its lines are not. Training begins with
the document's label for each line; then lines of bad documents that look good
count as good (at least one line of each stays bad), and the field is fitted
once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import cut, sample_labelled, slices
from docmill.llm.terms import _bytes
from docmill.llm.toxicity import _logistic

#: Bytes of text that are worked on at once; longer texts go in pieces, cut at line ends, or inside a longer line.
PIECE = 1 << 22
#: Numbers that describe a line.
FEATURES = ("length", "letters", "capitals", "digits", "signs", "points", "spaces", "bars", "shouts", "beyond", "words", "word_length", "capital_words", "signed_words", "repeated", "distinct", "begins", "ends", "same_line")
#: Intervals of each number.
BINS = 8
_KIND = np.zeros(256, np.uint8)
_SPACE, _UPPER, _LOWER, _DIGIT, _POINT, _SIGN, _BEYOND = range(1, 8)
_KIND[:33] = _SPACE
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _UPPER
_KIND[97:123] = _LOWER
_KIND[[ord(c) for c in ".,;:'\"()?-"]] = _POINT
_KIND[127:] = _BEYOND
_HASH = np.random.default_rng(12).integers(1, 1 << 62, 256, dtype=np.uint64)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES of each line of the texts (no nulls), its bytes, and the texts' bounds among the lines.

    Lines are what stands between line feeds; lines without a visible character
    are left out.
    """
    a, offsets = _bytes(texts)
    if not len(a):
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(a == 10) + 1]))
    starts, ends = cuts[:-1], cuts[1:]
    kind = _KIND[a]
    visible = kind != _SPACE
    left = np.concatenate([[False], visible[:-1]])
    left[starts] = False
    right = np.concatenate([visible[1:], [False]])
    right[ends - 1] = False
    w0, w1 = np.flatnonzero(visible & ~left), np.flatnonzero(visible & ~right) + 1
    first, last = np.searchsorted(w0, starts), np.searchsorted(w0, ends)
    full = last > first
    starts, ends, first, last = starts[full], ends[full], first[full], last[full]
    lines = len(starts)
    seen = _sums(visible, starts, ends).astype(float)
    upper, lower, beyond = (_sums(kind == k, starts, ends) for k in (_UPPER, _LOWER, _BEYOND))
    words = (last - first).astype(float)
    power = np.full(int((w1 - w0).max(initial=1)), np.uint64(0x9E3779B97F4A7C15))
    power[:1] = 1
    power = np.multiply.accumulate(power)
    inside = np.flatnonzero(visible)
    of = np.repeat(np.arange(len(w0)), w1 - w0)
    hashes = np.add.reduceat(_HASH[a[inside]] * power[inside - w0[of]], np.cumsum(w1 - w0) - (w1 - w0)) if len(w0) else np.zeros(0, np.uint64)
    line = np.repeat(np.arange(lines), last - first)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])])
    order = np.lexsort((hashes, line))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])])
    distinct = np.bincount(line[order][new], minlength=lines)
    begin, end = kind[w0], kind[w1 - 1]
    whole = np.add.reduceat(hashes, first) if lines else hashes
    text = np.searchsorted(offsets, starts, "right") - 1
    same = np.concatenate([[False], (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])])
    finish = a[w1[last - 1] - 1]
    x = np.column_stack([
        np.log1p(seen),
        (upper + lower + beyond) / seen,
        upper / np.maximum(upper + lower, 1),
        _sums(kind == _DIGIT, starts, ends) / seen,
        _sums(kind == _SIGN, starts, ends) / seen,
        _sums(kind == _POINT, starts, ends) / seen,
        (ends - starts - seen) / np.maximum(words, 1),
        _sums(a == 124, starts, ends) / words,
        _sums(a == 33, starts, ends) / words,
        beyond / seen,
        np.log1p(words),
        seen / words,
        np.bincount(line, begin == _UPPER, lines) / words,
        np.bincount(line, end == _SIGN, lines) / words,
        np.bincount(line, again, lines) / words,
        distinct / words,
        (kind[w0[first]] == _UPPER) * 1.0,
        np.isin(finish, [46, 63, 58]) * 1.0,
        same * 1.0,
    ])
    return x, ends - starts, np.searchsorted(starts, offsets)


def _pieces(text: str) -> Iterator[str]:
    lo = 0
    while lo < len(text):
        hi = text.rfind("\n", lo, lo + PIECE) + 1 if len(text) - lo > PIECE else len(text)
        hi = hi if hi > lo else lo + PIECE
        yield text[lo:hi]
        lo = hi


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of whole texts, long ones in pieces."""
    if not len(texts) or texts.nbytes <= PIECE or len(texts) > 1 and texts.nbytes <= 2 * PIECE:
        return line_features(texts)
    xs, sizes, counts = [], [], []
    for t in texts.to_pylist():
        parts = [line_features(pa.array([p], pa.string())) for p in _pieces(t)]
        xs += [x for x, _, _ in parts]
        sizes += [n for _, n, _ in parts]
        counts.append(sum(len(n) for _, n, _ in parts))
    whole = np.concatenate([np.zeros((0, len(FEATURES))), *xs])
    return whole, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def forward_backward(e: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of being good, the log of its chain's sum, and the probabilities of the label pairs of each line and the one before.

    e is each line's evidence for good (bad has 0), pairs the 2 x 2 weights of
    neighbouring labels, bounds the chains' limits. All chains go step by step
    together, the longest longest.
    """
    first, n = bounds[:-1], np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    a, b = np.zeros((2, len(e))), np.zeros((2, len(e)))
    a[1] = e
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        before = a[:, at - 1]
        a[0, at] = np.logaddexp(before[0] + pairs[0, 0], before[1] + pairs[1, 0])
        a[1, at] = np.logaddexp(before[0] + pairs[0, 1], before[1] + pairs[1, 1]) + e[at]
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        bad, good = b[0, at + 1], b[1, at + 1] + e[at + 1]
        b[0, at] = np.logaddexp(bad + pairs[0, 0], good + pairs[0, 1])
        b[1, at] = np.logaddexp(bad + pairs[1, 0], good + pairs[1, 1])
    both = a + b
    total = np.logaddexp(both[0], both[1])
    inner = np.ones(len(e), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    odds = np.zeros((4, len(at)))
    for i in (0, 1):
        for j in (0, 1):
            odds[2 * i + j] = np.exp(a[i, at - 1] + pairs[i, j] + j * e[at] + b[j, at] - total[at])
    return 1 / (1 + np.exp(np.clip(both[0] - both[1], -500, 500))), total, odds


@dataclass
class QualityModel:
    """Limits of the intervals, weights of each interval for a line and its neighbours, the pair weights, and the document's coefficients."""

    edges: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    coefficients: list[float]

    def intervals(self, x: np.ndarray) -> np.ndarray:
        """Each line's intervals, as places among all weights of a line."""
        found = [np.searchsorted(e, x[:, i], "right") + i * BINS for i, e in enumerate(self.edges)]
        return np.stack(found, 1) if len(found) else np.zeros((len(x), 0), np.int64)

    def evidence(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each line's evidence: its own and its neighbours' intervals."""
        own, before, after = (w[at].sum(1) for w in self.weights)
        return own + _moved(before, bounds, 1) + _moved(after, bounds, -1)

    def document(self, p: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Constant, log-odds of the mean probability of a text's bytes, share of its bytes in lines that are rather bad, length (log)."""
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = np.bincount(of, sizes, len(bounds) - 1)
        mean = np.where(n > 0, np.bincount(of, sizes * p, len(n)) / np.maximum(n, 1), 0.5)
        bad = np.bincount(of, sizes * (p < 0.5), len(n)) / np.maximum(n, 1)
        mean = np.clip(mean, 1e-3, 1 - 1e-3)
        return np.column_stack([np.ones(len(n)), np.log(mean / (1 - mean)), bad, np.log1p(n) / 10])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text."""
        x, sizes, bounds = _features(texts)
        p = forward_backward(self.evidence(self.intervals(x), bounds), self.pairs, bounds)[0]
        z = self.document(p, sizes, bounds) @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _moved(values: np.ndarray, bounds: np.ndarray, by: int) -> np.ndarray:
    """Values of the neighbour before (1) or after (-1) each line in its text, 0 where there is none."""
    out = np.roll(values, by)
    full = np.diff(bounds) > 0
    out[bounds[:-1][full] if by > 0 else bounds[1:][full] - 1] = 0
    return out


def fit_field(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 2, steps: int = 150, ridge: float = 0.02) -> QualityModel:
    """Fits the field to texts' lines by their texts' labels, and the document's coefficients.

    Maximises the weighted conditional log-likelihood of the lines' labels
    (mean a line) by Adam's steps; between rounds lines of bad texts that look
    good get that label.
    """
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(x, inner, axis=0).T
    lines = np.repeat(np.arange(len(labels)), np.diff(bounds))
    y, w = labels[lines].astype(float), (weights / weights.mean())[lines]
    model = QualityModel(edges, np.zeros((3, len(FEATURES) * BINS)), np.zeros((2, 2)), [0.0, 1.0, 0.0, 0.0])
    at = model.intervals(x)
    flat, many = at.ravel(), len(FEATURES) * BINS
    inside = np.ones(len(x), bool)
    inside[bounds[:-1][np.diff(bounds) > 0]] = False
    inside = np.flatnonzero(inside)
    for turn in range(rounds):
        theta = np.concatenate([model.weights.ravel(), model.pairs.ravel()])
        m = v = np.zeros(len(theta))
        seen = np.bincount((2 * y[inside - 1] + y[inside]).astype(int), w[inside], 4)
        for step in range(1, steps + 1):
            p, _, odds = forward_backward(model.evidence(at, bounds), model.pairs, bounds)
            r = w * (y - p)
            parts = [np.bincount(flat, np.repeat(z, len(FEATURES)), many) for z in (r, _moved(r, bounds, -1), _moved(r, bounds, 1))]
            slope = (np.concatenate([*parts, seen - (odds * w[inside]).sum(1)]) - ridge * theta * len(x) / 100) / len(x)
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            model.weights, model.pairs = theta[:-4].reshape(3, -1), theta[-4:].reshape(2, 2)
        p = forward_backward(model.evidence(at, bounds), model.pairs, bounds)[0]
        if turn + 1 < rounds:
            least = np.full(len(labels), np.inf)
            np.minimum.at(least, lines, p)
            y = np.where((labels[lines] == 0) & ((p < 0.5) | (p <= least[lines])), 0.0, 1.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_label: int = 1_500, most_lines: int = 48) -> QualityModel | None:
    """Learns from labelled rows; None where a label, 0 or 1, has no text with a line.

    Training rows are a sample of about per_label of each label, each text of
    an id once, and of each at most most_lines lines in a row, from a place that
    its hash gives (the documented bound): numbers of these lines reach the
    driver, some 150 bytes each, never texts. Labels other than 0 and 1 are not
    learned.
    """
    known = labels.select(key, F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    keys = sample_labelled(known, "y", [key], per_label)
    rows = docs.select(key, F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("t is not null")
    joined = rows.join(F.broadcast(keys.withColumnRenamed("weight", "w")), key).dropDuplicates([key, "h"])
    again = sample_labelled(joined, "y", ["h", key], 2 * per_label)  # ids with many texts
    sample = cut(again.select("t", "y", (F.col("w") * F.col("weight")).alias("w"), "h"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", PIECE):
            x, sizes, bounds = _features(b.column(0))
            n = np.diff(bounds)
            lo = bounds[:-1] + b.column(3).to_numpy() % (np.maximum(n - most_lines, 0) + 1)
            hi = np.minimum(lo + most_lines, bounds[1:])
            packed = [pa.array([z[i:j].astype("<f4").tobytes() for i, j in zip(lo, hi)], pa.binary()) for z in (x, sizes)]
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), *packed], ["y", "w", "h", "x", "n"])

    got = sample.mapInArrow(numbers, "y int, w double, h long, x binary, n binary").where("length(n) > 0").collect()
    got.sort(key=lambda r: (r.y, r.h, r.n))
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r.x, "<f4") for r in got]).reshape(-1, len(FEATURES)).astype(float)
    sizes = np.concatenate([np.frombuffer(r.n, "<f4") for r in got]).astype(float)
    bounds = np.concatenate([[0], np.cumsum([len(r.n) // 4 for r in got])])
    w = np.array([r.w for r in got])
    model = fit_field(x, bounds, y, w)
    p = forward_backward(model.evidence(model.intervals(x), bounds), model.pairs, bounds)[0]
    model.coefficients = _logistic(model.document(p, sizes, bounds), y.astype(float), w)
    return model


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text; one narrow pass.

    A null text is the empty one; a text without lines has the score that its
    length alone gives, and every text 0.5 without a model. Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", PIECE):
            yield pa.record_batch([b.column(0), pa.array(model.scores(b.column(1)) if model else np.full(b.num_rows, 0.5))], ["i", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, score double").withColumnRenamed("i", id_col)
