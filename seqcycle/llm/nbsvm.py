"""Quality classifier: naive Bayes features under a linear support vector machine.

Each text becomes the set of its word n-grams and a few character n-grams, hashed to ``2**bits`` columns. A column's
value is 1 if present, times the log ratio of its smoothed counts in the two classes (the naive Bayes weight); rows are
scaled to unit length. The hinge loss with L2 penalty is minimised by dual coordinate descent. A logistic curve, fitted
to margins on folds that the model did not see, turns margins into scores.

Defined results: null texts count as empty; an empty text has no features, so its score is that of the intercept. Rows
whose label is null or neither 0 nor 1 are not learnt from. If only one class (or none) has labels, every score is that
class's share (0.5 without labels). A doc_id of several labels is learnt once with each. A null doc_id never counts as learnt from (held_out is null, as the remainder is).
Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_row, hashed_sample, mix64, written

#: Hashed columns; bound of the labelled rows (and of their bytes of text) that a fit takes, by hash order of doc_id.
BITS, SAMPLE_ROWS, SAMPLE_BYTES = 18, 8_000, 60_000_000


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct column numbers of a whole text: words as written, pairs of words, each word's outline and pairs of those,
    the share of pairs that repeat an earlier one (in sixteenths), and the count of words (by powers of two).

    The outline maps letters to ``a`` or ``A`` and digits to ``0``, so it tells shouting, tables and stray symbols apart
    from prose in words that the training texts never had.
    """
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    h = hashes.array(words)
    outline = hashes.array([_outline(w) for w in words])
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    shapes = (outline[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ outline[1:]
    again = np.uint64(16 * (len(two) - len(np.unique(two))) // max(len(two), 1))
    repeats = np.array([again + np.uint64(1000), np.uint64(2000 + len(words).bit_length())], np.uint64)
    allh = np.concatenate([h, mix64(two), mix64(outline + np.uint64(1)), mix64(shapes + np.uint64(2)), mix64(repeats)])
    return np.unique((mix64(allh) >> np.uint64(64 - bits)).astype(np.int64))


def _outline(word: str) -> str:
    if word.isalpha():
        return "A" if word.isupper() else "Aa" if word[0].isupper() else "a"
    return "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))[:8]


@dataclass
class Model:
    weights: np.ndarray  # per column: naive Bayes ratio times the support vector weight
    ratio: np.ndarray
    bias: float
    scale: float  # of the logistic curve
    shift: float

    def margin(self, columns: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[columns]).sum())) if len(columns) else 0.0
        return self.bias + (float(self.weights[columns].sum()) / norm if norm else 0.0)

    def score(self, columns: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * self.margin(columns) + self.shift, -30, 30))))


def _descend(rows: list[np.ndarray], inverse: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int):
    """Dual coordinate descent for L2-penalised hinge loss; the intercept is a further column of value 1.

    A row's values are ``inverse * ratio[columns]``. Kept are the products of weight and ratio, so that no row's values need be held.
    """
    product, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    squared = np.square(ratio)
    square = np.where(inverse > 0, 2.0, 1.0)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at = rows[i].astype(np.intp)
            own = product.take(at)
            grad = y[i] * (inverse[i] * own.sum() + bias) - 1.0
            step = min(max(alpha[i] - grad / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                product[at] = own + step * y[i] * inverse[i] * squared.take(at)
                bias += step * y[i]
                worst = max(worst, abs(step) * square[i])
        if worst < 1e-3:
            break
    return product, bias


def _train(rows: list[np.ndarray], y: np.ndarray, size: int, c: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    logs = []
    for side in (1, -1):
        count = np.ones(size)
        for i in np.flatnonzero(y == side):
            count[rows[i]] += 1.0  # a row's columns are distinct
        logs.append(np.log(count) - np.log(count.sum()))
    ratio = logs[0] - logs[1]
    norms = np.array([np.sqrt(np.square(ratio[r]).sum()) for r in rows])
    inverse = np.divide(1.0, norms, out=np.zeros(len(rows)), where=norms > 0)
    share = np.array([(y == -1).mean(), (y == 1).mean()])
    cost = np.where(y == 1, c * 0.5 / max(share[1], 1e-9), c * 0.5 / max(share[0], 1e-9))
    product, bias = _descend(rows, inverse, ratio, y, cost, epochs, seed)
    return product, ratio, bias


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve by Newton's method, with softened targets and both classes of equal weight."""
    pos, neg = (y == 1).sum(), (y == -1).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / max(pos, 1), 0.5 / max(neg, 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - target)
        d = weight * p * (1 - p) + 1e-12
        h = np.array([[np.dot(d, margins**2) + 1e-9, np.dot(d, margins)], [np.dot(d, margins), d.sum() + 1e-9]])
        step = np.linalg.solve(h, np.array([np.dot(g, margins), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (max(a, 1e-3), b)


def fit(texts: list[str | None], labels: list[int], *, bits: int = BITS, c: float = 1.0, epochs: int = 20, folds: int = 4, seed: int = 7) -> Model:
    """Trains on texts with labels 0 or 1."""
    hashes = WordHashes()
    return fitted([features(t, hashes, bits) for t in texts], labels, bits=bits, c=c, epochs=epochs, folds=folds, seed=seed)


def fitted(rows: list[np.ndarray], labels: list[int], *, bits: int = BITS, c: float = 1.0, epochs: int = 20, folds: int = 4, seed: int = 7) -> Model:
    """Trains on the columns of texts with labels 0 or 1."""
    size, y = 1 << bits, np.where(np.asarray(labels, dtype=int) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = float((y == 1).mean()) if len(y) else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        here = np.flatnonzero(fold != k)
        if len(set(y[here].tolist())) < 2:
            continue
        part = Model(*_train([rows[i] for i in here], y[here], size, c, epochs, seed), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    weights, ratio, bias = _train(rows, y, size, c, epochs, seed)
    scale, shift = _curve(margins, y)
    return Model(weights, ratio, bias, scale, shift)


def training_rows(docs: DataFrame, labels: DataFrame, *, held_out: str = "crc32(cast(doc_id as string)) % 3 = 1", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES, read: Callable = lambda text: text) -> tuple[list, list]:
    """The bounded sample of labelled rows that a fit takes: at most ``rows`` rows of ``docs`` with a label and ``text_bytes`` bytes of text.

    Rows come in the order of a hash of their doc_id, whole; each one that fits within what is left of both bounds is taken.
    Labels of documents that are not in ``docs`` take no place. A doc_id of two labels, or of two rows, counts as often.
    Of each text, what ``read`` makes of it is kept. Fails if there are labelled texts and none fits.
    """
    known = labels.where(f"quality in (0, 1) and not ({held_out})").select("doc_id", F.col("quality").cast("int").alias("quality"))
    present = written(docs.select("doc_id").join(known, "doc_id").select("doc_id", "quality"), "labelled")
    chosen = hashed_sample(present, "doc_id", present.count(), rows).distinct()  # at most ``rows`` rows
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    known_texts, marks, total, skipped = [], [], 0, 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        if len(marks) == rows:
            break
        size = len((row.text or "").encode())
        if total + size > text_bytes:
            skipped += 1
            continue
        total += size
        known_texts.append(read(row.text))
        marks.append(row.quality)
    if skipped and not known_texts:
        raise ValueError(f"none of {skipped} labelled texts is within {text_bytes} bytes")
    return known_texts, marks


def scored(docs: DataFrame, model: Model, *, bits: int = BITS) -> DataFrame:
    """Adds ``score`` (0 to 1) to the rows of ``docs``; all columns stay, and only texts leave the engine."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, m = WordHashes(), held.value
        for texts in batches:
            yield by_row(texts, lambda t: m.score(features(t, hashes, bits)), pa.float64())

    return docs.withColumn("score", score("text"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document of ``docs`` with ``score`` and ``predicted`` (1 at a score of 0.5 or more)."""
    hashes = WordHashes()
    model = fitted(*training_rows(docs, labels, read=lambda text: features(text, hashes).astype(np.int32)))
    return scored(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
