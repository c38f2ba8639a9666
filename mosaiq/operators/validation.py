"""Constraint queries over outputs and inputs: each names a rule and counts the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, violations, passed); a null outcome is a violation. One pass over the rows."""
    counted = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    return counted.unpivot([], list(checks), "rule", "violations").withColumn("passed", F.col("violations") == 0)


def unique(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    n = rows.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
    return n.select(F.lit(rule).alias("rule"), "violations", (F.col("violations") == 0).alias("passed"))


def distance_rules(distances: DataFrame) -> DataFrame:
    """Distances are in the unit interval, a reference has none to itself, and the hybrid is the sum of the streams."""
    unit = lambda c: F.col(c).between(0.0, 1.0)
    checks = {
        "unit_interval": unit("resnet_distance") & unit("temporal_distance") & unit("spatial_distance"),
        "self_distance_zero": (F.col("video_no") != 0) | ((F.col("resnet_raw") == 0) & (F.col("temporal_raw") == 0) & (F.col("spatial_raw") == 0)),
        "hybrid_is_sum": F.col("hybrid_raw") == F.col("resnet_raw") + F.col("temporal_raw") + F.col("spatial_raw"),
    }
    return reduce(DataFrame.unionByName, [rules(distances, checks), unique(distances, ["video_id", "segment_id"], "unique_segments")])


def inventory(rows: DataFrame, vectors: list[str], by: list[str]) -> DataFrame:
    """Rows, dimensions and finiteness of each vector column."""
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.max(F.size(v)).alias(f"{v}_size") for v in vectors), F.bool_and(reduce(lambda a, b: a & b, (finite(F.col(v)) for v in vectors))).alias("finite"))


def segment_times(features: DataFrame, first: DataFrame, second: DataFrame, video: str = "video_id") -> DataFrame:
    """Times of each feature segment: from the first manifest if it has any row of the recording, else from the second."""
    has = first.select(video).distinct().withColumn("_first", F.lit(True))
    a = first.select(video, "segment_id", F.col("start_s").alias("_a"))
    b = second.select(video, "segment_id", F.col("start_s").alias("_b"))
    joined = features.join(has, video, "left").join(a, [video, "segment_id"], "left").join(b, [video, "segment_id"], "left")
    return joined.withColumn("start_s", F.when(F.coalesce("_first", F.lit(False)), F.col("_a")).otherwise(F.col("_b"))).drop("_first", "_a", "_b")


def confusion_guard(predictions: DataFrame, rows: int, tp: int, tn: int, fp: int, fn: int) -> DataFrame:
    """Rules that a final table keeps: its number of rows and its confusion counts."""
    cell = lambda e, o: F.count_if((F.col("expected") == e) & (F.col("observed") == o))
    wanted = {"rows": (F.count(F.lit(1)), rows), "tp": (cell("abnormal", "abnormal"), tp), "tn": (cell("normal", "normal"), tn), "fp": (cell("normal", "abnormal"), fp), "fn": (cell("abnormal", "normal"), fn)}
    found = predictions.agg(*(c.alias(k) for k, (c, _) in wanted.items()))
    off = found.select(*(F.abs(F.col(k) - n).cast("bigint").alias(k) for k, (_, n) in wanted.items()))
    return off.unpivot([], list(wanted), "rule", "violations").withColumn("passed", F.col("violations") == 0)


def require(outcome: DataFrame) -> DataFrame:
    """The rules' outcome, or an error that names the first broken one when the rows are read."""
    broken = F.raise_error(F.concat(F.lit("rule broken: "), "rule")).cast("boolean")
    return outcome.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(broken))


def complete_segments(manifest: DataFrame, length: float = 5.0, fps: float = 1.0) -> DataFrame:
    """Ids of complete segments; a manifest of another segment length or sampling rate is an error when it is read."""
    same = (F.col("segment_length_seconds") == length) & (F.col("sample_fps") == fps)
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("segment_id")).otherwise(F.raise_error(F.concat(F.lit("unexpected sampling of "), "video_id")).cast("int"))
    return manifest.withColumn("segment_id", checked).filter("is_complete").select("video_id", "segment_id")
