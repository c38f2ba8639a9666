"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams over the whole text: 1 to 5 of its character classes (capitals, other letters, digits,
blanks, line ends, any other sign as itself; stretches of one class count once, of a sign once or as repeated) and 1 to 4
of the marks whether a word equals the one before it. They are hashed to DIMENSIONS columns. Each column is scaled by the
log ratio of its smoothed share in class 1 to that in class 0, counted over all labelled rows; on the scaled indicators
a linear support vector machine with hinge loss is fitted by dual coordinate descent, on a bounded sample of at most
`per_class` labelled rows a class: those with the smallest hashes of the id. The score is a logistic function of the
margin, fitted on margins of rows that the machine of the other half of the sample gave, weighted to the classes' shares.

Null and empty texts have no feature; the bias alone scores them. A row without a label, or with a label other than 0 and
1, or with a null id, is not learned from; each label of a repeated id counts with each row. With labels of one class only
the score is that class, without any 0.5. Repeated rows are scored alike, ties in the sample go to the smaller id, an
empty table gives an empty result. Texts go through the workers once; only the id and text columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from mosaiq.llm.common import mix64, slices

DIMENSIONS = 1 << 16
PER_CLASS = 2000
SHAPES, REPEATS = 5, 4
_CLASSES: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of each code point below 65,536: 1 capital, 2 other letter, 3 digit, 4 blank, 5 line end, else itself."""
    if not _CLASSES:
        table = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            kind = unicodedata.category(chr(c))
            if kind in ("Lu", "Lt"):
                table[c] = 1
            elif kind[0] in "LM":
                table[c] = 2
            elif kind[0] == "N":
                table[c] = 3
            elif chr(c).isspace():
                table[c] = 5 if c in (10, 13) else 4
        _CLASSES.append(table)
    return _CLASSES[0]


def ngrams(symbols: np.ndarray, most: int, seed: int) -> list[np.ndarray]:
    """Hashed n-grams of 1 to most symbols."""
    out, h = [], np.full(len(symbols), seed, np.uint64)
    for n in range(most):
        if n >= len(symbols):
            break
        h = mix64(h[: len(symbols) - n] * np.uint64(0x100000001B3) ^ symbols[n:])
        out.append(h)
    return out


def features(text: str | None) -> np.ndarray:
    """The columns of the text's n-grams, ascending, each once."""
    if not text:
        return np.zeros(0, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.where(points < 1 << 16, character_classes()[points & 0xFFFF], points)
    first = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    length = np.diff(np.append(first, len(classes)))
    symbols = classes[first].astype(np.uint64) + ((length > 1) & (classes[first] > 5)).astype(np.uint64) * np.uint64(1 << 32)
    words = text.split()
    again = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, max(0, len(words) - 1)).astype(np.uint64)
    hashes = ngrams(symbols, SHAPES, 1) + (ngrams(again, REPEATS, 2) if again.any() else [])
    return np.unique(np.concatenate(hashes) & np.uint64(DIMENSIONS - 1)).astype(np.uint16)


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the columns of each text as 16-bit numbers."""
    shape = StructType([StructField("id", docs.schema[key].dataType), *StructType.fromDDL("x binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "x"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, shape)


def fit_hinge(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, passes: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear SVM with hinge loss on scaled indicators, by dual coordinate descent; y is +1 or -1."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    square = np.array([(scale[i] ** 2).sum() + 1 for i in x])
    random = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in random.permutation(len(y)):
            on = x[i]
            gradient = y[i] * ((w[on] * scale[on]).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[on] += step * scale[on]
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-6 * cost:
            break
    return w * scale, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of the weighted logistic fit of smoothed labels, by Newton steps."""
    share = [(weight * (y == s)).sum() for s in (-1, 1)]
    target = np.where(y > 0, (share[1] + 1) / (share[1] + 2), 1 / (share[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        hessian = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hessian, [(g * margin).sum(), g.sum()])
        if not np.isfinite(move).all():
            break
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-9:
            break
    return max(a, 1e-3), b


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def score(self, columns: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        margin = float(self.weights[columns].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each column's smoothed share in class 1 (second row of counts) to that in class 0."""
    p, q = counts[1] + smooth, counts[0] + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def labelled(features_: DataFrame, labels: DataFrame, key: str, label: str, learn: Column | None) -> DataFrame:
    """(id, x, y) of the rows to learn from."""
    rows = features_ if learn is None else features_.filter(learn)
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    return rows.join(marks, "id")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows a class, rows a class and column) over all labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, DIMENSIONS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                counts[y, np.frombuffer(x, np.uint16)] += 1
                n[y] += 1
        held = np.flatnonzero(counts.sum(0))
        place = np.append(held, -1)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *(pa.array(np.append(counts[c, held], n[c])) for c in (0, 1))], ["place", "n0", "n1"])

    summed = rows.select("x", "y").mapInArrow(run, "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts, n = np.zeros((2, DIMENSIONS)), np.zeros(2)
    for r in summed.collect():  # at most a row a column
        (n if r["place"] < 0 else counts[:, r["place"]])[:] = r["n0"], r["n1"]
    return n, counts


def train(features_: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", learn: Column | None = None, per_class: int = PER_CLASS, cost: float = 1.0) -> QualityModel:
    """Fit on featurize()'s rows; learn: a condition over `id` that picks the rows to learn from."""
    rows = labelled(features_, labels, key, label, learn)
    n, counts = class_counts(rows)
    if not n.all():
        return QualityModel(np.zeros(DIMENSIONS), 0.0, 1.0, 0.0, 0.5 if not n.any() else float(n[1] > 0))
    scale = log_ratios(counts)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = F.lit(False)
    for y in (0, 1):  # about twice the rows, then the first by hash
        near = near | ((F.col("y") == y) & (F.col("draw") < int(min(1.0, 2 * per_class / n[y] + 0.001) * (1 << 30))))
    drawn = rows.withColumn("draw", draw).filter(near).withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("draw", "id", "x"))).filter(F.col("rank") <= per_class)
    sample = sorted(((r["y"], r["rank"], bytes(r["x"])) for r in drawn.select("y", "rank", "x").collect()))  # bounded by per_class
    x = [np.frombuffer(s[2], np.uint16) for s in sample]
    y = np.array([1 if s[0] else -1 for s in sample])
    half = np.array([s[1] % 2 for s in sample])
    margin = np.zeros(len(y))
    if all(((half == k) & (y == s)).any() for k in (0, 1) for s in (-1, 1)):
        for k in (0, 1):
            there = np.flatnonzero(half != k)
            w, bias = fit_hinge([x[i] for i in there], y[there], scale, cost)
            for i in np.flatnonzero(half == k):
                margin[i] = w[x[i]].sum() + bias
        weight = np.array([n[int(s > 0)] / (y == s).sum() for s in y])
        slope, offset = fit_logistic(margin, y, weight * len(y) / weight.sum())
    else:
        slope, offset = 1.0, 0.0
    w, bias = fit_hinge(x, y, scale, cost)
    return QualityModel(w, bias, slope, offset)


def score(features_: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) of featurize()'s rows."""
    shared = features_.sparkSession.sparkContext.broadcast(model)
    shape = StructType([features_.schema["id"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(np.frombuffer(x, np.uint16)) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    return features_.select("id", "x").mapInArrow(run, shape)


def held_out(key: str = "id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))
