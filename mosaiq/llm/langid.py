"""Language identification by hierarchical discrimination.

A text's family is predicted first, by one linear support vector machine against the rest for each family. Within the
family one-versus-one linear support vector machines separate its languages by votes, then by margin. Features are
hashed character n-grams (1 to 3 characters with word edges) of the whole lower-case text: the square roots of their
counts at unit length. Training is by dual coordinate descent on a bounded sample of labelled rows: at most
`per_language` rows of a language, chosen by a hash of the id.

A text that is null or has no letter is `und` with score 0. Rows without a label, with a null id or without letters
are not learned from. With `least_margin` and `least_likeness` a text of SHORT characters or more is `und` with score 0 too
if its best family margin and its likeness to every language are both less: it looks like nothing learned. Without any
labelled row every prediction is `und`. Ties go to the first language by name.
Repeated rows are predicted alike; very long texts are counted whole; an empty table gives an empty result; only the
id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from mosaiq.llm.common import slices

DIMENSIONS = 1 << 12
PER_LANGUAGE = 600
UNDETERMINED = "und"
SHORT = 100
#: Families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_HASH = np.uint32(0x9E3779B1)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(text: str | None) -> np.ndarray | None:
    """The feature vector; None if there is no letter."""
    if not text or not any(map(str.isalpha, text[:64])) and not any(map(str.isalpha, text)):
        return None
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[c < 65] = 32  # digits, marks and white space separate words
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    shift = np.uint32(32 - 12)
    one = c * _HASH
    two = (one[:-1] ^ c[1:] + np.uint32(0x85EBCA77)) * _HASH
    three = (two[:-1] ^ c[2:] + np.uint32(0xC2B2AE3D)) * _HASH
    counts = np.bincount(np.concatenate([one, two, three]) >> shift, minlength=DIMENSIONS)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 15, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss linear SVM; y is +1 or -1. Dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    weight = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    diagonal = np.array([0.5 / (cost * weight[int(s)]) for s in y])
    square, random = (x * x).sum(1) + diagonal, np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in random.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if (step := new - alpha[i]) != 0:
                w += np.float32(step * y[i]) * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[str, ...]
    family_weights: np.ndarray
    languages: dict[str, tuple[str, ...]]
    pair_weights: dict[tuple[str, str], np.ndarray]
    centres: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> LanguageModel:
        lang_of = np.array(lang, object)
        family = np.array([family_of(v) for v in lang], object)
        families = tuple(sorted(set(family)))
        own = {f: tuple(sorted(set(lang_of[family == f]))) for f in families}
        weights = [train_svm(x, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(x.shape[1] + 1, np.float32)]
        pairs = {}
        for members in own.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (lang_of == a) | (lang_of == b)
                    pairs[a, b] = train_svm(x[rows], np.where(lang_of[rows] == a, 1, -1))
        means = np.array([x[lang_of == v].mean(axis=0) for v in sorted(set(lang))])
        return cls(families, np.array(weights), own, pairs, means / np.linalg.norm(means, axis=1, keepdims=True))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """(language, score): the score is the logistic of the family's lead times the mean logistic of the won pairs."""
        one = np.append(x, np.float32(1))
        margins = self.family_weights @ one
        best = int(np.argmax(margins))
        lead = margins[best] - np.delete(margins, best).max() if len(margins) > 1 else 8.0
        members = self.languages[self.families[best]]
        votes = {m: [0, 0.0, []] for m in members}
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                m = float(self.pair_weights[a, b] @ one)
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                votes[a][2].append(m)
                votes[b][2].append(-m)
        won = min(members, key=lambda k: (-votes[k][0], -votes[k][1], k))
        sure = np.mean([_logistic(4 * m) for m in votes[won][2]]) if votes[won][2] else 1.0
        return won, float(_logistic(2 * lead) * sure)

    def margin(self, x: np.ndarray) -> float:
        """The best family's margin: about 1 for a text like those learned from, about 0 for one that no family explains."""
        return float((self.family_weights @ np.append(x, np.float32(1))).max()) if len(self.families) > 1 else np.inf

    def likeness(self, x: np.ndarray) -> float:
        """The largest cosine to the mean vector of a language."""
        return float((self.centres @ x).max())


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on at most per_language labelled rows a language: those with the smallest hashes of the id."""
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("key").isNotNull())
    if learn is not None:
        labelled = docs.filter(learn).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("key").isNotNull())
    usable = labelled.filter(F.length("text") > 0).withColumn("draw", F.pmod(F.xxhash64("key"), F.lit(1 << 30)))
    count = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not count:
        return None
    near = F.lit(False)
    for lang, n in count.items():  # about twice the rows, then the first by hash
        near = near | ((F.col("lang") == lang) & (F.col("draw") < int(min(1.0, 2 * per_language / n + 0.001) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            vectors = [None if (v := features(t)) is None else v.tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("draw"), batch.column("lang"), pa.array(vectors, pa.binary())], ["key", "draw", "lang", "x"])

    drawn = usable.filter(near).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))).filter(F.col("rank") <= per_language)
    rows = drawn.select(F.col("key").cast("bigint").alias("key"), "draw", "lang", "text").mapInArrow(run, "key long, draw long, lang string, x binary").filter(F.col("x").isNotNull()).collect()  # bounded by per_language
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["key"]))
    return LanguageModel.fit(np.array([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", least_margin: float = -np.inf, least_likeness: float = -np.inf) -> DataFrame:
    """docs with lang_pred and score; texts below both least_margin and least_likeness are undetermined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in columns), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def one(t: str | None) -> tuple[str, float]:
        model = shared.value
        if model is None or (x := features(t)) is None:
            return UNDETERMINED, 0.0
        if len(t) >= SHORT and model.likeness(x) < least_likeness and model.margin(x) < least_margin:
            return UNDETERMINED, 0.0
        return model.predict(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [one(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*columns, "lang_pred", "score"])

    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))
