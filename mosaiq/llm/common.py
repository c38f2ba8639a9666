"""Helpers shared by the corpus operators: tables, shared folders, Arrow batches and word shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not got.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mosaiq-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get()


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mosaiq/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about most_bytes of the text column, never splitting a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, by element."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct string, by xxhash."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in values.to_pylist()), dtype=np.uint64, count=len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row bounds): the words of the lower-case text between white space; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat, bounds = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    hashes = string_hashes(coded.dictionary)
    idx = coded.indices.to_numpy(zero_copy_only=False)
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), bounds
    hashed = hashes[idx]
    blank = coded.dictionary.index("").as_py()
    if blank >= 0:  # leading or trailing white space leaves empty words
        keep = idx != blank
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        hashed = hashed[keep]
    return hashed, bounds


def shingle_hashes(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, row bounds). A text of 1 to k-1 words has one shingle: all its words."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    total = int(out[-1])
    if not total:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(len(n)), n)
    start = bounds[:-1][row] + (np.arange(total) - out[:-1][row])
    size = np.minimum(counts, k)[row]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.full(total, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        nxt = padded[start + j]
        h = np.where(j < size, mix64(h * np.uint64(0x100000001B3) ^ nxt), h)
    return h, out


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values in ascending order without repeats."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(bounds) - 1))]).astype(np.int64)


def ragged_take(values: np.ndarray, bounds: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values of the rows idx, one after another, and their bounds."""
    n = (bounds[1:] - bounds[:-1])[idx]
    out = np.concatenate([[0], np.cumsum(n)])
    if not out[-1]:
        return values[:0], out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1][idx] - out[:-1], n)
    return values[at], out
