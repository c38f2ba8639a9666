"""Tables behind reports: inventories, completion, labels, run times and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import scalars as S


def count_pivot(rows: DataFrame, by: str, label: str, values: list[str]) -> DataFrame:
    """Counts by label in fixed columns; absent ones are 0."""
    return rows.groupBy(by).pivot(label, values).count().na.fill(0)


def stage_status(log: DataFrame, videos: DataFrame, stages: list[str]) -> DataFrame:
    """The last status of every recording and stage; null where a stage never ran. videos times stages rows."""
    last = log.groupBy("video_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    grid = videos.select("video_id").distinct().select("video_id", F.explode(F.lit(stages)).alias("stage"))
    return grid.join(last, ["video_id", "stage"], "left")


def runtime(log: DataFrame, by: list[str], run_id: str | None = None, strict: bool = False) -> DataFrame:
    """Runs, outcomes and seconds. Blank run ids belong to the current run unless strict."""
    if run_id is not None:
        log = log.filter((F.col("run_id") == run_id) | (F.lit(not strict) & (F.coalesce("run_id", F.lit("")) == "")))
    seconds = F.col("duration_text").cast("double") if strict else F.col("duration_text").try_cast("double")
    return log.filter(~F.col("stage").startswith("sleep")).groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("cache_reused").alias("cache_reused"), F.round(F.sum(seconds), 6).alias("seconds"))


def failures(log: DataFrame, predictions: DataFrame) -> DataFrame:
    """Failed stages and wrong predictions in one table."""
    a = log.filter("status = 'failed'").select(F.col("video_id").cast("string").alias("video_id"), F.concat(F.lit("stage failed: "), "stage").alias("reason"))
    b = predictions.filter("expected <> observed").select(F.col("video_id").cast("string").alias("video_id"), F.concat(F.lit("expected "), "expected", F.lit(", observed "), "observed").alias("reason"))
    return a.unionByName(b)


def transformation_rows(rows: DataFrame, column: str = "transformation") -> DataFrame:
    """In display order, then by lower-case file name."""
    return rows.orderBy(S.transformation_order(F.col(column)), F.lower("filename"))


def first_wrong(predictions: DataFrame, n: int = 6) -> DataFrame:
    """The first n false positives and false negatives, for figures."""
    fp, fn = predictions.filter("expected = 'normal' and observed = 'abnormal'"), predictions.filter("expected = 'abnormal' and observed = 'normal'")
    return fp.orderBy("video_id").limit(n).unionByName(fn.orderBy("video_id").limit(n))


def overview(videos: DataFrame) -> DataFrame:
    """Duration, size, rate and megabits; nulls as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return videos.select("video_id", zero(F.col("duration")).alias("duration"), F.concat(F.coalesce(F.col("width"), F.lit(0)).cast("string"), F.lit("x"), F.coalesce(F.col("height"), F.lit(0)).cast("string")).alias("resolution"), zero(F.col("fps")).alias("fps"), zero(F.col("bit_rate") / 1e6).alias("mbps"))


def long_thresholds(limits: DataFrame, keys: list[str], streams: list[str]) -> DataFrame:
    """One row a stream from one column a stream."""
    return limits.unpivot(keys, streams, "stream", "threshold")


def with_fold_threshold(scores: DataFrame, limits: DataFrame, group: str = "source_id", fold: str = "held_out") -> DataFrame:
    """Each recording's largest score beside the threshold of the fold that held it out."""
    return scores.join(F.broadcast(limits.withColumnRenamed(fold, group)), group, "left").withColumn("exceeds", F.coalesce(F.col("max_value") > F.col("threshold"), F.lit(False)))


def point_size(pixels: Column) -> Column:
    return F.least(F.lit(300.0), F.greatest(F.lit(30.0), pixels / 5000))


def comparison_methods(rows: DataFrame, methods: tuple[str, str]) -> DataFrame:
    """Exactly two methods, in the order given; byte equality is not one of them."""
    if len(set(methods)) != 2 or any("sha" in m.lower() for m in methods):
        raise ValueError("two methods other than byte equality are compared")
    return rows.filter(F.col("method").isin(*methods)).orderBy(F.array_position(F.lit(list(methods)), F.col("method")))
