"""Stages over recordings that resume where a run ended and stop a source whose reference failed.

The log is a table of outcomes (source_id, video_id, stage, cache_key, status, reason, attempt, seq). What is left to do is
the recordings and stages without a completed row for their present cache key: an anti-join, nothing is kept in memory. A
stage writes what it makes first and its log rows last, under the name of the attempt; rows of an attempt that the log does
not name are not read. A run that breaks anywhere therefore ends, when it is started again, with the same tables as one
that does not.

A cache key is the SHA-256 of the key of the stage before, the stage's name and parameters and the recording's fields that
it depends on: a changed input or parameter makes this stage and those after it due again. Within a stage the references
come first; the other recordings of a source wait for its reference and are not run if it failed. A failed recording takes
no part in later stages and is tried again by the next run. A source without a reference is stopped from the start.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = "source_id string, video_id string, stage string, cache_key string, status string, reason string, attempt string, seq long"


@dataclass(frozen=True)
class Stage:
    """run gets the recordings due and the tables of the earlier stages by name; it returns video_id, columns of its own and `error`, null where all went well."""

    name: str
    run: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    fields: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


def states(videos: DataFrame, log: DataFrame, stages: list[str]) -> DataFrame:
    """The state of each recording at each stage, by the last log row: completed, ready, failed (and ready again), waiting or blocked.

    videos: source_id, video_id, is_reference. A recording waits while an earlier stage of it is not completed, and while
    its reference has not completed the stage; it is blocked if the reference failed there or before, or is missing.
    """
    last = log.groupBy("video_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    grid = videos.select("source_id", "video_id", "is_reference", F.posexplode(F.lit(stages)).alias("place", "stage")).join(last, ["video_id", "stage"], "left")
    own = Window.partitionBy("video_id").orderBy("place")
    earlier = F.coalesce(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    failed_before = F.coalesce(F.bool_or(F.coalesce(F.col("status") == "failed", F.lit(False))).over(own), F.lit(False))
    marked = grid.select("*", earlier.alias("earlier"), failed_before.alias("failed_so_far"))
    ref = marked.filter("is_reference").groupBy("source_id", "place").agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("ref_done"), F.bool_or("failed_so_far").alias("ref_failed"))
    both = marked.join(ref, ["source_id", "place"], "left")
    follows = ~F.col("is_reference")
    state = (
        F.when(F.col("status") == "completed", "completed")
        .when(follows & (F.col("ref_failed").isNull() | F.col("ref_failed")), "blocked")
        .when(~F.col("earlier") | (follows & ~F.col("ref_done")), "waiting")
        .when(F.col("status") == "failed", "failed")
        .otherwise("ready")
    )
    return both.select("source_id", "video_id", "is_reference", "stage", state.alias("state"))


def with_keys(videos: DataFrame, stages: list[Stage]) -> DataFrame:
    """videos with key_<stage> of every stage."""
    before = F.lit("")
    for s in stages:
        told = json.dumps(s.parameters, sort_keys=True, separators=(",", ":"), allow_nan=False)
        mine = F.to_json(F.struct(*s.fields), {"ignoreNullFields": "false"}) if s.fields else F.lit("{}")
        videos = videos.withColumn(f"key_{s.name}", F.sha2(F.concat_ws("\n", before, F.lit(s.name), F.lit(told), mine), 256))
        before = F.col(f"key_{s.name}")
    return videos


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log so far; empty before the first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LOG).parquet(f"{folder}/log") if there else spark.createDataFrame([], LOG)


def current(log: DataFrame, keyed: DataFrame, stages: list[Stage]) -> DataFrame:
    """The log rows that still hold: those with the present key of their recording and stage."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s.name).alias("stage"), F.col(f"key_{s.name}").alias("cache_key")) for s in stages)))
    wanted = keyed.select("video_id", pairs.alias("k")).select("video_id", "k.*")
    return log.join(wanted, ["video_id", "stage", "cache_key"], "left_semi")


def results(spark: SparkSession, folder: str, stage: str, log: DataFrame) -> DataFrame | None:
    """What a stage made for the recordings that completed it, from the attempts that the log names; None if it never ran."""
    last = log.filter(F.col("stage") == stage).groupBy("video_id").agg(F.max_by(F.struct("status", "attempt"), "seq").alias("l"))
    good = last.filter("l.status = 'completed'").select("video_id", F.col("l.attempt").alias("attempt"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/results/{stage}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    made = spark.read.option("mergeSchema", "true").parquet(f"{folder}/results/{stage}").withColumn("attempt", F.col("attempt").cast("string"))
    return made.join(good, ["video_id", "attempt"], "left_semi").drop("attempt")


def run(videos: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """Bring every recording as far as it goes and return states(). videos: source_id, video_id, is_reference and the fields of the stages."""
    spark = videos.sparkSession
    if any(s.name.startswith("key_") or "/" in s.name for s in stages) or len({s.name for s in stages}) < len(stages):
        raise ValueError("stages have different, plain names")
    keyed, names = with_keys(videos, stages), [s.name for s in stages]
    for s in stages:
        for references in (True, False):
            log = current(read_log(spark, folder), keyed, stages)
            due = states(videos, log, names).filter((F.col("stage") == s.name) & F.col("state").isin("ready", "failed") & (F.col("is_reference") == references)).select("video_id")
            work = keyed.join(due, "video_id", "left_semi")
            if work.limit(1).count() == 0:
                continue
            earlier = {n: results(spark, folder, n, log) for n in names[: names.index(s.name)]}
            attempt = uuid.uuid4().hex
            target = f"{folder}/results/{s.name}/attempt={attempt}"
            s.run(work.drop(*(f"key_{n}" for n in names)), earlier).write.parquet(target)
            error = spark.read.parquet(target).groupBy("video_id").agg(F.max("error").alias("reason"), F.count(F.lit(1)).alias("made"))
            seq = (log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] or 0) + 1
            told = work.join(error, "video_id", "left").select(
                "source_id",
                "video_id",
                F.lit(s.name).alias("stage"),
                F.col(f"key_{s.name}").alias("cache_key"),
                F.when(F.col("made").isNotNull() & F.col("reason").isNull(), "completed").otherwise("failed").alias("status"),
                F.when(F.col("made").isNull(), "no result").otherwise(F.col("reason")).alias("reason"),
                F.lit(attempt).alias("attempt"),
                F.lit(seq).cast("long").alias("seq"),
            )
            told.write.mode("append").parquet(f"{folder}/log")
    return states(videos, current(read_log(spark, folder), keyed, stages), names)
