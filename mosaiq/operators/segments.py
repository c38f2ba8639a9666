"""Segment and sample grids, adjacent-frame pairs and segment aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["video_id", "segment_id"]

# The features of adjacent frames and of single frames.
PAIR_FEATURES = ("mad", "absdiff_std", "rmse", "changed_ratio", "p90", "edge_change")
SHARPNESS_FEATURES = ("variance_laplacian", "tenengrad_sharpness", "edge_density", "high_frequency_dct_energy_ratio", "local_contrast")


def segment_grid(videos: DataFrame, length: float = 5.0, keep_partial: bool = False, duration: str = "duration") -> DataFrame:
    """Complete segments of each video, and a partial last one if kept; with the processed and discarded seconds."""
    whole = F.greatest(F.floor(F.col(duration) / length + 1e-9), F.lit(0)).cast("int")
    rest = F.col(duration) - whole * length
    partial = F.when((rest > 1e-9) & F.lit(keep_partial), 1).otherwise(0)
    n = whole + partial
    grid = videos.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_n", n).filter("_n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("segment_id"))
    start = F.col("segment_id") * F.lit(length)
    complete = F.col("segment_id") < F.col("_whole")
    return grid.select(
        *videos.columns,
        "segment_id",
        start.alias("start_s"),
        F.when(complete, start + length).otherwise(F.col(duration)).alias("end_s"),
        complete.alias("is_complete"),
        (F.lit(0.0) if keep_partial else F.when(F.col("_rest") > 1e-9, F.col("_rest")).otherwise(0.0)).alias("discarded_s"),
    )


def sample_times(segments: DataFrame, fps: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Middles of the sampling intervals strictly inside each segment."""
    n = F.greatest(F.floor((F.col(end) - F.col(start)) * fps + 1e-9), F.lit(0)).cast("int")
    times = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.col(start) + (i + 0.5) / fps, 6))).otherwise(F.array().cast("array<double>"))
    return segments.select("*", F.posexplode(times).alias("sample_index", "ts_s")).filter(F.col("ts_s") < F.col(end))


def adjacent_pairs(frames: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each frame with the next of its segment. A failed side makes a failed pair; no pair bridges a failed frame."""
    order = Window.partitionBy(*keys).orderBy("frame_index")
    nxt = frames.select(*keys, "frame_index", "ts_s", "value", "success", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("frame_index", "ts_s", "value", "success")))
    ok = F.col("success") & F.col("next_success")
    change = F.when(ok, F.abs(F.col("next_value") - F.col("value")))
    pairs = nxt.filter(F.col("next_frame_index").isNotNull())
    return pairs.select(*keys, F.col("frame_index").alias("pair_index"), ok.alias("ok"), change.alias("change"), F.when(ok, (F.col("ts_s") + F.col("next_ts_s")) / 2).alias("middle_s"))


def pair_counts(pairs: DataFrame, expected: Column, keys: list[str] = KEYS) -> DataFrame:
    """Pairs that the sampling grid expects, that succeeded and failed, and that are missing of the expected; never below 0."""
    out = pairs.groupBy(*keys).agg(F.max(expected).cast("bigint").alias("expected_pairs"), F.count_if("ok").alias("successful_pairs"), F.count_if(~F.col("ok")).alias("failed_pairs"))
    return out.withColumn("missing_pairs", F.greatest(F.col("expected_pairs") - F.col("successful_pairs"), F.lit(0)).cast("bigint"))


def wide(rows: DataFrame, features: list[str], statistics: tuple[str, ...], keys: list[str] = KEYS) -> DataFrame:
    """Statistics of several feature columns side by side, named <statistic>_<feature>: one pass, one row a segment.

    Null features do not count; a segment without any row has none here.
    """
    how = {"mean": F.avg, "std": F.stddev_pop, "standard_deviation": F.stddev_pop, "minimum": F.min, "max": F.max, "p10": lambda c: F.percentile(c, 0.1), "median": lambda c: F.percentile(c, 0.5)}
    return rows.groupBy(*keys).agg(*(how[s](F.col(f)).alias(f"{s}_{f}") for s in statistics for f in features))


def temporal_vector(pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The 18 values of a segment's adjacent-frame changes: means, deviations, then largest values of six features."""
    return wide(pairs, list(PAIR_FEATURES), ("mean", "std", "max"), keys)


def sharpness_vector(frames: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The 25 values of a segment's sharpness: five statistics of five measures."""
    return wide(frames, list(SHARPNESS_FEATURES), ("mean", "standard_deviation", "minimum", "p10", "median"), keys)


def pair_features(pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean, population deviation and largest change, with pair counts: expected, decoded and failed."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected_pairs"),
        F.count_if("ok").alias("decoded_pairs"),
        F.count_if(~F.col("ok")).alias("failed_pairs"),
        F.avg("change").alias("mean_change"),
        F.stddev_pop("change").alias("std_change"),
        F.max("change").alias("max_change"),
    )


def largest_change(pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The pair of the largest change of each segment, the first of equals."""
    best = F.max_by(F.struct("pair_index", "middle_s", "change"), F.struct(F.col("change"), -F.col("pair_index")))
    return pairs.filter("ok").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def spread(frames: DataFrame, value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """Mean, population deviation, least value, tenth percentile and median."""
    v = F.col(value)
    return frames.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.5).alias("median"), F.count(v).alias("frames"))


def vector_mean_std(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Mean and population deviation of every dimension, as arrays in dimension order."""
    cells = rows.select(*keys, F.posexplode(vector).alias("pos", "v"))
    stats = cells.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda x: x["mean"].cast("float")).alias("mean"), F.transform("s", lambda x: x["std"].cast("float")).alias("std"), F.concat(F.transform("s", lambda x: x["mean"].cast("float")), F.transform("s", lambda x: x["std"].cast("float"))).alias("combined"))


def successes(frames: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Successful frames numbered from 0 within the segment."""
    return frames.filter("success").withColumn("row_index", F.row_number().over(Window.partitionBy(*keys).orderBy("frame_index")) - 1)


def frame_counts(frames: DataFrame, expected: Column, keys: list[str] = KEYS) -> DataFrame:
    """Frames used and failed or missing, never below 0."""
    used = F.count_if("success")
    return frames.groupBy(*keys).agg(F.max(expected).alias("expected"), used.alias("used")).withColumn("failed_or_missing", F.greatest(F.col("expected") - F.col("used"), F.lit(0)))
