"""Nested leave-one-source-out evaluation with hoisted digests.

A model depends on the set of training sources only: all but one, or all but two. The quantiles of all these sets come
from one rank table a dimension. Segments are paired with their references once; each pair goes once through a worker
that holds a block of models and computes its distances under each model that needs it. What leaves the worker is small:
counts of equal distances by model (for the thresholds) and the largest scores of a recording (for the decisions), since a
recording is abnormal if its largest score or blur loss exceeds a threshold. No row is joined with a set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from mosaiq.functions import vectors as V
from mosaiq.operators import compare, evaluation, models, order_stats
from mosaiq.sources.adapters import RESNET, SPATIAL, TEMPORAL

# The weight and margin grids.
WEIGHTS = ((0, 0.4, 0.3, 0.3), (1, 0.3, 0.2, 0.5), (2, 0.5, 0.25, 0.25))
TWO_STREAM_WEIGHTS = ((0, 0.5, 0.5, 0.0), (1, 0.7, 0.3, 0.0), (2, 0.3, 0.7, 0.0))
MARGINS = (1.5, 3.0)
BITS = RESNET + 2 * TEMPORAL + 2 * SPATIAL
TWO_STREAM_BITS = RESNET + 2 * TEMPORAL
LENGTHS = (RESNET, 2 * TEMPORAL, 2 * SPATIAL)
#: Bytes of the models that a worker holds at a time; more are served in further passes over the pairs.
BLOCK_BYTES = 64 << 20
#: Differing bits of the Gray codes of two quartile bins.
GRAY_DISTANCE = np.array([[bin((a ^ a >> 1) ^ (b ^ b >> 1)).count("1") for b in range(4)] for a in range(4)], np.int64)
_KEY = ["out_a", "out_b"]
_OUT = pa.schema([*((c, pa.string()) for c in ("out_a", "out_b", "source_id", "video_id", "profile")), *((c, pa.int64()) for c in ("resnet_raw", "temporal_raw", "spatial_raw", "n")), ("scores", pa.list_(pa.float64())), ("blur_loss", pa.float64())])


def pairs_with_references(segments: DataFrame) -> DataFrame:
    """Each segment that its reference (video_no 0) has too, with both vectors and the blur loss."""
    vector = models.all_streams(segments).cast("array<double>")
    ref = segments.filter("video_no = 0").select("source_id", "segment_id", vector.alias("r"), F.col("spatial").alias("ref_spatial"))
    own = segments.select("source_id", "video_id", "segment_id", "profile", (F.col("video_no") <= 4).alias("calibration"), vector.alias("v"), "spatial")
    # dealt by the join's own keys: a given number, so that the work on the pairs is not put into few tasks
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, ref = (df.repartition(parts, "source_id", "segment_id") for df in (own, ref))
    return own.join(ref, ["source_id", "segment_id"]).select("source_id", "video_id", "profile", "calibration", "v", "r", V.blur_loss(F.col("ref_spatial"), F.col("spatial")).alias("blur_loss"))


class ModelBlock:
    """Fitted models as arrays, a row a training set."""

    def __init__(self, rows: list):
        self.sets = [(r["out_a"], r["out_b"]) for r in rows]
        self.median, self.scale, q1, q3 = (np.array([r[c] for r in rows]) for c in ("median", "scale", "q1", "q3"))
        self.low, self.high = (((q - self.median) / self.scale).astype(np.float32) for q in (q1, q3))

    def codes(self, k: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sign bits of the first stream, quartile bins of the others) of vectors under the k-th model; the same rules as models.digests."""
        x = np.clip((v - self.median[k]) / self.scale[k], -V.CLIP, V.CLIP).astype(np.float32)
        rest = x[:, RESNET:]
        bins = np.where(rest >= self.high[k, RESNET:], 3, np.where(rest >= 0, 2, np.where(rest >= self.low[k, RESNET:], 1, 0)))
        return x[:, :RESNET] >= 0, bins

    def distances(self, k: int, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Differing bits by pair and stream."""
        (bits, bins), (ref_bits, ref_bins) = self.codes(k, v), self.codes(k, r)
        gray = GRAY_DISTANCE[bins, ref_bins]
        return np.stack([(bits != ref_bits).sum(1), gray[:, :TEMPORAL].sum(1), gray[:, TEMPORAL:].sum(1)], axis=1)


def served(pairs: DataFrame, fitted: DataFrame, sets: list[tuple[str, str]], weights: tuple, profiles: bool) -> DataFrame:
    """Two kinds of rows: counts of equal distances of the calibration pairs by set (n), and the largest scores of recordings of left-out sources."""
    size = max(1, BLOCK_BYTES // (4 * 8 * (RESNET + TEMPORAL + SPATIAL)))
    parts = []
    for start in range(0, len(sets), size):
        block = sets[start : start + size]
        chosen = fitted if size >= len(sets) else fitted.join(F.broadcast(pairs.sparkSession.createDataFrame(block, "out_a string, out_b string")), _KEY)
        model = pairs.sparkSession.sparkContext.broadcast(ModelBlock(chosen.collect()))  # bounded by BLOCK_BYTES
        parts.append(pairs.mapInArrow(_serve(model, weights, profiles), from_arrow_schema(_OUT)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _serve(shared, weights: tuple, profiles: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        base = np.array([n + 1 for n in LENGTHS])
        seen: dict[tuple[int, str | None], list[np.ndarray]] = {}  # (set, profile) -> coded distances with counts
        for batch in batches:
            v, r = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("v", "r"))
            source, video, profile = (np.array(batch.column(c).to_pylist(), object) for c in ("source_id", "video_id", "profile"))
            calibration, blur = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("calibration", "blur_loss"))
            held = []
            for k, (a, b) in enumerate(block.sets):
                out = (source == a) | (source == b)
                rows = np.flatnonzero(calibration.astype(bool) | out)
                if not len(rows):
                    continue
                raw = block.distances(k, v[rows], r[rows])
                out = out[rows]
                coded = (raw[:, 0] * base[1] + raw[:, 1]) * base[2] + raw[:, 2]
                kinds = profile[rows] if profiles and a == b else np.full(len(rows), None, object)
                for kind in set(kinds[~out].tolist()):
                    own = ~out & np.array([x == kind for x in kinds]) if kind is not None else ~out
                    _count(seen.setdefault((k, kind), []), *np.unique(coded[own], return_counts=True))
                if out.any():
                    at = rows[out]
                    d = raw[out] / np.array(LENGTHS, float)
                    scores = [(wr * d[:, 0] + wt * d[:, 1] + ws * d[:, 2]) / (wr + wt + ws) for _, wr, wt, ws in weights]
                    frame = pd.DataFrame({"source_id": source[at], "video_id": video[at], "profile": profile[at], "blur_loss": blur[at], **{str(i): s for i, s in enumerate(scores)}})
                    held.append(frame.groupby(["source_id", "video_id", "profile"], dropna=False, sort=False).max().reset_index().assign(out_a=a, out_b=b))
            if held:
                frame = pd.concat(held)
                frame["scores"] = list(frame[[str(i) for i in range(len(weights))]].to_numpy())
                yield _batch(frame)
        for (k, kind), tables in seen.items():
            codes, n = _count(tables)
            a, b = block.sets[k]
            raw = {"resnet_raw": codes // (base[1] * base[2]), "temporal_raw": codes // base[2] % base[1], "spatial_raw": codes % base[2]}
            yield _batch(pd.DataFrame({**raw, "n": n, "out_a": a, "out_b": b, "profile": kind}))

    return run


def _count(tables: list[np.ndarray], codes: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Add coded distances with counts; merge what has gathered once it is long, or for reading."""
    if codes is not None:
        tables.append(np.stack([codes, n]))
    if codes is None or sum(t.shape[1] for t in tables) > 1 << 14:
        every = np.concatenate(tables, axis=1)
        merged, at = np.unique(every[0], return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, at, every[1])
        tables[:] = [np.stack([merged, total])]
    return tables[0][0], tables[0][1]


def _batch(frame: pd.DataFrame) -> pa.RecordBatch:
    missing = {f.name: None for f in _OUT if f.name not in frame}
    return pa.RecordBatch.from_pandas(frame.assign(**missing)[_OUT.names], _OUT, preserve_index=False)


def weighted(distances: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """One row for each entry of the weight grid."""
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("weight_no"), F.lit(r).alias("wr"), F.lit(t).alias("wt"), F.lit(s).alias("ws")) for i, r, t, s in weights)))
    rows = distances.select("*", grid.alias("g")).select(*distances.columns, "g.*")
    return rows.withColumn("score", (F.col("wr") * F.col("resnet_distance") + F.col("wt") * F.col("temporal_distance") + F.col("ws") * F.col("spatial_distance")) / (F.col("wr") + F.col("wt") + F.col("ws")))


def thresholds(scored: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """Score thresholds by set, weight and margin (and what else `by` has) from counted scores: (by, weight_no, score, n).

    Scores are ratios of bit counts, so a group has few different ones: percentiles with frequencies hold only these."""
    by = [*by, "weight_no"]
    equal = scored.groupBy(*by, "score").agg(F.sum("n").alias("n"))
    middle = equal.groupBy(*by).agg(F.percentile("score", 0.5, F.col("n")).alias("median"))
    far = equal.join(middle, by).withColumn("off", F.abs(F.col("score") - F.col("median")))
    found = far.groupBy(*by).agg(F.max("score").alias("largest"), F.percentile("off", 0.5, F.col("n")).alias("mad"), F.sum("n").alias("n"))
    found = found.select("*", F.explode(F.lit(list(MARGINS))).alias("margin"))
    return evaluation.with_threshold(found, F.col("margin"), 1 / bits).select(*by, "margin", F.col("threshold").alias("score_threshold"), "n")


def blur_thresholds(pairs: DataFrame, sources: list[str]) -> DataFrame:
    """Blur thresholds by set and margin; the loss does not depend on a model, so one rank table serves all sets."""
    found = order_stats.spread(pairs.filter("calibration"), "blur_loss", [], group="source_id", leave_out=2, groups=sources)
    found = found.select("*", F.explode(F.lit(list(MARGINS))).alias("margin"))
    return evaluation.with_threshold(found, F.col("margin"), 1e-6).select(*_KEY, "margin", F.col("threshold").alias("blur_threshold"))


def decide(scored: DataFrame, limits: DataFrame, videos: DataFrame, folds: DataFrame, by: list[str], own: DataFrame | None = None) -> DataFrame:
    """Videos are abnormal if any segment exceeds a threshold strictly or their structure differs.

    videos has every registered recording with its expected label and `structural`; folds says which source each model
    judges. A recording without a compared segment has a row too, judged by its structure. own: score thresholds by
    profile, which go before the common ones.
    """
    fold = [*by, "out_a", "out_b", "source_id"]
    rows = scored.join(folds, ["out_a", "out_b", "source_id"]).join(limits, ["out_a", "out_b", "weight_no"])
    limit = F.col("score_threshold")
    if own is not None:
        rows = rows.join(own.select("out_a", "out_b", "weight_no", "margin", "profile", F.col("score_threshold").alias("_own")), ["out_a", "out_b", "weight_no", "margin", "profile"], "left")
        limit = F.coalesce("_own", limit)
    over = (F.col("score") > limit) | (F.col("blur_loss") > F.col("blur_threshold"))
    judged = rows.groupBy(*fold, "weight_no", "margin", "video_id").agg(F.bool_or(over).alias("over"))
    every = videos.join(folds, "source_id").join(limits.select("out_a", "out_b", "weight_no", "margin").distinct(), ["out_a", "out_b"])
    out = every.join(judged, [*fold, "weight_no", "margin", "video_id"], "left")
    return out.withColumn("observed", F.when(F.coalesce("over", F.lit(False)) | F.col("structural"), "abnormal").otherwise("normal"))


def evaluate(segments: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, two_streams: bool = False, adaptive: bool = False, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected parameters by outer fold, outer predictions).

    two_streams: the first version, without the spatial stream and blur loss. adaptive: outer decisions use the
    threshold of the recording's compression profile; the parameters are selected without profiles. registry names all
    recordings with their sources and expected labels; those without any segment are abnormal, as all are missing. With
    fewer than four sources an inner fold would train on one source: it is skipped, all parameters are equally good and
    the first are taken, with metrics of 0.
    """
    spark = segments.sparkSession
    grid, bits = (TWO_STREAM_WEIGHTS, TWO_STREAM_BITS) if two_streams else (WEIGHTS, BITS)
    sources = sorted(r[0] for r in segments.select("source_id").distinct().collect())  # one a fold
    sets = [(a, b) for i, a in enumerate(sources) for b in sources[i:] if a == b or len(sources) > 3]
    calibration = segments.filter("video_no <= 4")
    fitted = models.fit_without(calibration.select("source_id", models.all_streams(calibration).alias("v")), F.col("v"), "source_id", sources, 2 if len(sources) > 3 else 1)
    pairs = keep(pairs_with_references(segments))
    table = keep(served(pairs, fitted, sets, grid, adaptive))
    counted = table.filter("n is not null")
    for stream, length in zip(("resnet", "temporal", "spatial"), LENGTHS):
        counted = counted.withColumn(f"{stream}_distance", F.col(f"{stream}_raw").cast("double") / length)
    counted = weighted(counted, grid)
    limits = thresholds(counted, _KEY, bits).drop("n")
    if two_streams:
        limits = limits.withColumn("blur_threshold", F.lit(1.0))
    else:
        limits = limits.join(blur_thresholds(pairs, sources), [*_KEY, "margin"])
    limits = keep(limits)
    score = F.posexplode("scores").alias("weight_no", "score")
    scored = table.filter("n is null").select("out_a", "out_b", "source_id", "video_id", "profile", F.lit(0.0).alias("blur_loss") if two_streams else "blur_loss", score)
    issues = compare.structural_issues(segments, ["source_id"]).select("source_id", "video_id", "structural")
    known = (segments if registry is None else registry).select("source_id", "video_id", "expected").distinct()
    videos = known.join(issues, ["source_id", "video_id"], "left").withColumn("structural", F.coalesce("structural", F.lit(True)))
    # the pair (a, b) serves both ways: outer a with inner b, outer b with inner a
    ways = [w for a, b in sets if a != b for w in ((a, b, a, b), (a, b, b, a))]
    folds = spark.createDataFrame(ways, "out_a string, out_b string, outer_out string, source_id string")
    held = decide(scored.filter("out_a <> out_b"), limits, videos, folds, ["outer_out"])
    found = evaluation.counts(held, ["outer_out", "weight_no", "margin"])
    grids = spark.createDataFrame([(s, w[0], m) for s in sources for w in grid for m in MARGINS], "outer_out string, weight_no int, margin double")
    quality = evaluation.metrics(grids.join(found, ["outer_out", "weight_no", "margin"], "left").fillna(0, ["tp", "tn", "fp", "fn"]), zero=True)
    selected = keep(evaluation.best_parameters(quality, ["outer_out"], ["weight_no", "margin"]).select("outer_out", "weight_no", "margin", "balanced_accuracy", "f1"))
    last = limits.filter("out_a = out_b")
    own = thresholds(counted.filter("out_a = out_b"), [*_KEY, "profile"], bits) if adaptive else None
    outer = spark.createDataFrame([(s, s, s) for s in sources], "out_a string, out_b string, source_id string")
    decided = decide(scored.filter("out_a = out_b"), last, videos, outer, [], own)
    chosen = decided.join(selected.select(F.col("outer_out").alias("out_a"), "weight_no", "margin"), ["out_a", "weight_no", "margin"])
    return selected, chosen.select(F.col("out_a").alias("held_out"), "video_id", "expected", "observed", "weight_no", "margin")
