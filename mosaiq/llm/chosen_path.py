"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. In each of `runs` independent runs the sets are split by the shingle
that a random order puts first in them: two sets choose the same one with the probability of their Jaccard similarity.
A bucket that is still larger than `small` is split again, and so on, by `branches` fresh orders at once, so that every
set goes on along several paths: whatever the depth, two sets at the threshold stay together on some path with the
probability of `survival`. Recursion ends where buckets are small, or where TRIES splits in turn do not lessen the number
of pairs, which happens to buckets of sets that are alike; these are compared by brute force. Runs repeat until a pair at
the threshold is missed with a probability of less than 1 - `recall`; one more run makes good for splits taken again.

Equal texts are one set with a weight. A bucket with the same members as another one is dropped; a pair that meets in
several buckets counts in the first. Large buckets are compared in pairs of blocks of at most `block` sets, so no task
holds an unbounded bucket. Tasks return sums by document and the links of a spanning forest, never all pairs.

The result has a row for each row of docs: its class (the least id that its text is linked to, directly or through
others), its links (other rows with texts of similarity `threshold` or more, copies included) and the links to different
texts. Every row with an id is a document, so rows that repeat an id are judged by their own texts. A null text, and one
without words, has no links and is its own class. Null ids have no links and a null class. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import SHINGLE_WORDS, discard, distinct_sorted, materialize, mix64, shingle_hashes, shuffle_partitions, slices
from mosaiq.llm.components import components

THRESHOLD, RECALL = 0.8, 0.99995
SMALL, BLOCK = 512, 512
#: A split must leave less than this share of a bucket's pairs, over all its branches, or the bucket is compared whole.
PROGRESS, TRIES = 0.8, 3
BROADCAST = 100_000
_MIX = np.uint64(0x100000001B3)


def branches_for(threshold: float) -> int:
    """Orders by which a large bucket is split at once: enough for paths of similar sets not to die out."""
    return max(2, math.ceil(1.5 / threshold))


def survival(threshold: float, branches: int) -> float:
    """The least probability that two sets at the threshold stay together in a run, however deep it goes."""
    below = 1.0
    for _ in range(200):
        below = 1 - (1 - threshold * below) ** branches
    return threshold * below


def runs_for(threshold: float, recall: float, branches: int | None = None) -> int:
    """Runs after which a pair at the threshold has met with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, branches or branches_for(threshold))))


def paths(docs: DataFrame, runs: int, k: int) -> DataFrame:
    """Per document: text hash and the bucket of the first chosen shingle in each run."""
    seeds = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            h, bounds = shingle_hashes(batch.column("text"), k)
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            starts = bounds[:-1][full]
            at = np.stack([mix64(np.minimum.reduceat(mix64(h ^ seed), starts) + np.uint64(j)) for j, seed in enumerate(seeds)], 1)
            keys, sha = (batch.column(c).take(pa.array(full)) for c in ("key", "sha"))
            ends = pa.array(np.arange(0, (len(full) + 1) * runs, runs), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, sha, pa.ListArray.from_arrays(ends, pa.array(at.ravel().view(np.int64)))], ["doc_id", "sha", "path"])

    return docs.mapInArrow(run, "doc_id long, sha binary, path array<long>")


def split(members: DataFrame, branches: int, k: int) -> DataFrame:
    """members (rep, buckets: bucket and tries, text) -> (rep, parent, bucket): the next shingle chosen in each bucket along each branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            h, bounds = shingle_hashes(batch.column("text"), k)
            buckets, reps = batch.column("buckets"), batch.column("rep").to_numpy()
            ends = buckets.offsets.to_numpy()
            parents, tries = (buckets.values.field(c).to_numpy()[ends[0] : ends[-1]].astype(np.uint64) for c in ("bucket", "tries"))
            row = np.repeat(np.arange(len(reps)), np.diff(ends))
            seeds = mix64(parents[:, None] + (tries[:, None] * np.uint64(branches) + np.arange(1, branches + 1, dtype=np.uint64)) * _MIX)
            out = []
            for i, orders in zip(row.tolist(), seeds):
                own = h[bounds[i] : bounds[i + 1]]
                out += mix64(np.array([mix64(own ^ seed).min() for seed in orders]) * _MIX ^ orders).tolist()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[row], branches)), pa.array(np.repeat(parents, branches).view(np.int64)), pa.array(np.array(out, np.uint64).view(np.int64))], ["rep", "parent", "bucket"])

    return members.mapInArrow(run, "rep long, parent long, bucket long")


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of sets and each of others have in common."""
    values, at = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    n = [len(x) for x in (*sets, *others)]
    rows = np.repeat(np.arange(len(n)), n)
    common = np.zeros((len(sets), len(others)), np.float32)
    order = np.argsort(at, kind="stable")
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    rows, at = rows[order], at[order]
    keep = shared[at]
    rows, at = rows[keep], column[at[keep]]
    for low in range(0, int(shared.sum()), 4096):  # columns in pieces of bounded memory
        part = slice(np.searchsorted(at, low), np.searchsorted(at, low + 4096))
        x = np.zeros((len(n), min(4096, int(shared.sum()) - low)), np.float32)
        x[rows[part], at[part] - low] = 1
        common += x[: len(sets)] @ x[len(sets) :].T
    return common


def _similar(sets: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each of sets and each of others have that Jaccard similarity."""
    common = _common(sets, others)
    union = np.array([len(x) for x in sets], np.float64)[:, None] + np.array([len(x) for x in others], np.float64)[None, :] - common
    return common >= threshold * union - 1e-9


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def compare(members: DataFrame, threshold: float, k: int) -> DataFrame:
    """members (bucket, a, b, side, rep, weight, met, text) -> (rep, other, links, texts): sums have a null other, forest links have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            bucket, a, b = held[0][:3]
            left = [r for r in held if r[3] == 0]
            right = left if a == b else [r for r in held if r[3] == 1]
            held.clear()
            if not left or not right:
                return
            near = _similar([r[7] for r in left], [r[7] for r in right], threshold)
            if a == b:
                near = np.triu(near, 1)
            if not near.any():
                return
            # a pair counts in the first bucket that both are in
            near &= _common(*([np.array([x for x in r[6] if x < bucket], np.int64) for r in rows] for rows in (left, right))) == 0
            weight_l, weight_r = np.array([r[5] for r in left], np.int64), np.array([r[5] for r in right], np.int64)
            out = []
            for rows, links, texts in ((left, near @ weight_r, near.sum(1)), (right, weight_l @ near, near.sum(0))):
                out += [(r[4], None, int(x), int(n)) for r, x, n in zip(rows, links, texts) if n]
            ids = sorted({r[4] for r in left} | {r[4] for r in right})
            place = {v: i for i, v in enumerate(ids)}
            forest = _Forest(len(ids))
            for i, j in zip(*np.nonzero(near)):
                p, q = left[i][4], right[j][4]
                if forest.join(place[p], place[q]):
                    out.append((p, q, 0, 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "other", "links", "texts"])

        for batch in slices(batches, "text", 2 << 20):
            h, bounds = distinct_sorted(*shingle_hashes(batch.column("text"), k))
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "side", "rep", "weight", "met")))):
                if held and held[0][:3] != row[:3]:
                    yield from done()
                held.append((*row, h[bounds[i] : bounds[i + 1]]))
        if held:
            yield from done()

    return members.mapInArrow(run, "rep long, other long, links long, texts long")


def _with_texts(hashed: DataFrame, named: DataFrame, wanted: DataFrame, rows: int | None = None) -> DataFrame:
    """wanted (rep, ...) with weight and text. Up to BROADCAST rows are sent to the texts, else both sides are shuffled."""
    side = named.join(wanted, "rep").withColumnRenamed("first_id", "key")
    side = F.broadcast(side) if rows is not None and rows <= BROADCAST else side.hint("shuffle_hash")
    return hashed.join(side, ["sha", "key"]).dropDuplicates(["sha", "key"])  # repeated rows have one text


def buckets(sets: DataFrame, hashed: DataFrame, small: int, branches: int, k: int) -> DataFrame:
    """sets (rep, path, ...) -> (rep, bucket, n): small buckets, and large ones of sets that are alike."""
    named = sets.select("sha", "first_id", "rep", "weight")
    at = sets.select("rep", F.explode("path").alias("bucket"), F.lit(0).alias("tries"))
    found = None
    while True:
        counts = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members")).filter("n > 1")
        level = materialize(at.join(counts, "bucket").select("rep", "bucket", "tries", "n", "members"), "buckets")
        few = level.filter(F.col("n") <= small).drop("tries")
        found = few if found is None else found.unionByName(few)
        large = level.filter(F.col("n") > small)
        rows = large.count()
        if not rows:
            break
        wanted = large.groupBy("rep").agg(F.collect_list(F.struct("bucket", "tries")).alias("buckets"))  # at most a bucket a run and branch
        children = materialize(split(_with_texts(hashed, named, wanted, rows).select("rep", "buckets", "text"), branches, k), "bucket-children")
        pairs = children.groupBy("parent", "bucket").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        sizes = large.groupBy(F.col("bucket").alias("parent")).agg(F.max("n").cast("double").alias("n"), F.max("tries").alias("tries"))
        stuck = sizes.join(pairs, "parent").select("parent", "tries", (F.col("pairs") >= PROGRESS * F.col("n") * F.col("n")).alias("stuck"))
        stuck = materialize(stuck, "bucket-progress")
        held = large.join(stuck.filter("stuck").select(F.col("parent").alias("bucket")), "bucket", "left_semi")
        found = found.unionByName(held.filter(F.col("tries") == TRIES - 1).drop("tries"))
        again = held.filter(F.col("tries") < TRIES - 1).select("rep", "bucket", (F.col("tries") + 1).alias("tries"))
        at = children.join(stuck.filter("not stuck").select("parent"), "parent").select("rep", "bucket", F.lit(0).alias("tries")).unionByName(again)
    # the same members again: one bucket does
    first = found.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    return materialize(found.join(first.select("bucket"), "bucket", "left_semi").select("rep", "bucket", "n"), "buckets-kept")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.unhex(F.sha2(F.col(text), 256)).alias("sha"))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, k: int = SHINGLE_WORDS) -> DataFrame:
    """(sha, class_id, n_links, n_text_links) for every different text that has words, in a row with an id."""
    spark, branches = docs.sparkSession, branches_for(threshold)
    hashed = _rows(docs, key, text).filter("key is not null")
    found = paths(hashed, runs_for(threshold, recall, branches) + 1, k)

    # equal texts are one set, numbered as it is stored
    sets = found.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("path").alias("path"))
    sets = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "text-sets")
    named = sets.select("sha", "first_id", "rep", "weight")
    kept = buckets(sets, hashed, small, branches, k)
    met = kept.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("met"))  # at most a bucket a run and path
    need = materialize(_with_texts(hashed, named, met).select("rep", "weight", "met", "text"), "set-texts")

    # large buckets in pairs of blocks
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = kept.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    pairs = placed.select("rep", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pairs = pairs.select("rep", "bucket", F.least("mine", "with").alias("a"), F.greatest("mine", "with").alias("b"), F.when(F.col("mine") <= F.col("with"), 0).otherwise(1).alias("side"))
    dealt = pairs.join(need, "rep").repartition(shuffle_partitions(spark), "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    out = materialize(compare(dealt.select("bucket", "a", "b", "side", "rep", "weight", "met", "text"), threshold, k), "links")
    discard(need, kept)

    sums = out.filter("other is null").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = components(out.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    in_class = named.join(classes, "rep")
    least = in_class.groupBy("class_id").agg(F.min("first_id").alias("least_id"))
    ids = in_class.join(least, "class_id").select("rep", "least_id")
    every = named.join(sums, "rep", "left").join(ids, "rep", "left")
    return every.select("sha", F.coalesce("least_id", "first_id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links) for every row of docs. Options as for `linked`."""
    per_text = linked(docs, key, text, **options)
    with_id = F.col("key").isNotNull()
    per_row = _rows(docs, key, text).select("key", F.when(with_id, F.col("sha")).alias("sha")).join(per_text, "sha", "left")
    return per_row.select(F.col("key").alias("doc_id"), F.when(with_id, F.coalesce("class_id", "key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text's class has a smaller id. Rows with a null id stay; so do repeats of a row that stays."""
    classes = linked(docs, key, text, **options).filter((F.col("n_links") > 0)).select(F.col("sha").alias("__sha"), F.col("class_id").alias("__class"))
    found = docs.join(classes.hint("shuffle_hash"), F.unhex(F.sha2(docs[text], 256)) == F.col("__sha"), "left")
    return found.filter(F.col("__class").isNull() | docs[key].isNull() | (F.col("__class") == docs[key].cast("bigint"))).select(docs.columns)
