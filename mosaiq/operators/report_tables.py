"""Wide tables behind figures: scores beside fold thresholds, rates by transformation, completion, bit rates, stability.

Tables of thresholds, methods, stages and transformations are small and named by the caller; recordings and segments are not
bounded. Null scores stay null in tables and count as not exceeding. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import evaluation
from mosaiq.operators.reports import point_size, stage_status


def thresholds_by_fold(limits: DataFrame, streams: list[str], fold: str = "held_out") -> DataFrame:
    """A row a fold and a column `<stream>_threshold` a stream; null where a fold has none. Two thresholds of one fold and stream are an error."""
    one = F.when(F.count("threshold") > 1, F.raise_error(F.concat(F.lit("thresholds repeat in fold "), F.first(fold).cast("string"))).cast("double")).otherwise(F.max("threshold"))
    wide = limits.groupBy(fold, "stream").agg(one.alias("threshold")).groupBy(fold).pivot("stream", streams).agg(F.first("threshold"))
    return wide.select(fold, *(F.col(s).alias(f"{s}_threshold") for s in streams))


def scores_with_thresholds(rows: DataFrame, limits: DataFrame, streams: dict[str, str], keys: list[str], group: str = "source_id", fold: str = "held_out") -> DataFrame:
    """Each recording's largest and mean value of every stream ({stream: column}) beside the threshold of the fold that held its group out.

    `<stream>_exceeds` is false where a value or threshold is missing. keys contain the group.
    """
    made = [f(c).alias(f"{n}_{s}") for s, c in streams.items() for n, f in (("max", F.max), ("mean", F.avg))]
    top = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), *made)
    found = top.join(thresholds_by_fold(limits, list(streams), fold).withColumnRenamed(fold, group), group, "left")
    return found.select(*top.columns, *(c for s in streams for c in (F.col(f"{s}_threshold"), F.coalesce(F.col(f"max_{s}") > F.col(f"{s}_threshold"), F.lit(False)).alias(f"{s}_exceeds"))))


def rates_by_transformation(rows: DataFrame, label: str = "transformation", expected: str = "expected", observed: str = "observed") -> DataFrame:
    """Of each transformation and expected label: rows, and the detection rate of abnormal or the false rejection rate of normal ones.

    Rows whose observed label is not known are in `failed` and in no rate; a rate over no rows is null.
    """
    n = evaluation.counts_with_failed(rows.filter(F.col(expected).isin(*evaluation.LABELS)), [label, expected], expected, observed)
    return n.select(label, expected, "evaluated", "failed", F.try_divide(F.when(F.col(expected) == "abnormal", F.col("tp")), F.col("evaluated")).alias("detection_rate"), F.try_divide(F.when(F.col(expected) == "normal", F.col("fp")), F.col("evaluated")).alias("false_rejection_rate"))


def completion(log: DataFrame, videos: DataFrame, stages: list[str]) -> DataFrame:
    """A row a recording of `videos` and a column a stage: OK where the last run completed, FAIL where it did not, NA where it never ran.

    Recordings without a log row are there; log rows of other recordings and stages are not.
    """
    kept = log.filter(F.col("stage").isin(*stages))
    told = stage_status(kept, videos, stages).withColumn("seen", F.when(F.col("status").isNull(), "NA").when(F.col("status") == "completed", "OK").otherwise("FAIL"))
    return told.groupBy("video_id").pivot("stage", stages).agg(F.first("seen"))


def rates_and_scores(inventory: DataFrame, scores: DataFrame, score: str, benign: str = "benign") -> DataFrame:
    """Megabits, score and point size (reports.point_size) of each recording in both tables; nulls are 0.

    Recordings of the benign category; those of all categories where there is none that is benign.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    both = inventory.join(scores.select("video_id", score), "video_id")
    some = both.agg(F.coalesce(F.bool_or(F.col("category") == benign), F.lit(False)).alias("_some"))  # one row
    kept = both.crossJoin(F.broadcast(some)).filter(~F.col("_some") | (F.col("category") == benign))
    return kept.select("video_id", "category", (zero("bit_rate") / 1e6).alias("mbps"), zero(score).alias("score"), point_size(zero("width") * zero("height")).alias("point_size"))


def stability(rows: DataFrame, streams: dict[str, tuple[str, float]], by: list[str], recording: str, margin: float = 3.0) -> DataFrame:
    """Of each group of benign recordings, each one judged by thresholds from the others: would it be marked abnormal, and by which segments.

    streams: {name: (column, resolution)}; a segment is abnormal if a stream exceeds its threshold. A recording without others is left out.
    """
    parts = F.array(*(F.struct(F.lit(n).alias("stream"), F.col(c).alias("val"), F.lit(float(r)).alias("res")) for n, (c, r) in streams.items()))
    long = rows.select(*by, recording, "segment_id", F.explode(parts).alias("s")).select(*by, recording, "segment_id", "s.*")
    limits = evaluation.fold_thresholds(long, "val", [*by, "stream", "res"], margin, F.col("res"), recording, "_left_out").filter("n > 0")
    judged = long.join(limits.select(*by, "stream", F.col("_left_out").alias(recording), "threshold"), [*by, "stream", recording])
    segments = judged.groupBy(*by, recording, "segment_id").agg(F.coalesce(F.bool_or(F.col("val") > F.col("threshold")), F.lit(False)).alias("_over"))
    return segments.groupBy(*by, recording).agg(F.count(F.lit(1)).alias("tested_segments"), F.bool_or("_over").alias("would_be_marked_abnormal"), F.sort_array(F.collect_list(F.when(F.col("_over"), F.col("segment_id")))).alias("abnormal_segments"))


def primary_table(rows: DataFrame, confidence: DataFrame, fold: str = "source_id", method: str = "method") -> DataFrame:
    """A row a method: counts, and of each metric the point estimate, the interval (method, metric, low, high) and mean and deviation over folds."""
    n = evaluation.counts(rows, [method]).withColumn("total", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    point = evaluation.unpivot_metrics(evaluation.metrics(n), [method]).withColumnRenamed("value", "point_estimate")
    folds = evaluation.unpivot_metrics(evaluation.metrics(evaluation.counts(rows, [method, fold])), [method, fold])
    spread = folds.groupBy(method, "metric").agg(F.avg("value").alias("fold_mean"), F.stddev_samp("value").alias("fold_sd"))
    long = point.join(confidence.select(method, "metric", F.col("low").alias("ci_lower"), F.col("high").alias("ci_upper")), [method, "metric"], "left").join(spread, [method, "metric"], "left")
    parts = ("point_estimate", "ci_lower", "ci_upper", "fold_mean", "fold_sd")
    cells = [F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in evaluation.METRICS for p in parts]
    return n.join(long.groupBy(method).agg(*cells), method)
