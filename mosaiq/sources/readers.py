"""Sources: media registries, manifests, probe output, stored artifacts, CSV tables and configuration."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import subprocess
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from mosaiq.functions import scalars as S

# The fields of probe output that are read.
PROBE = (
    "struct<format: struct<duration: string, bit_rate: string, format_name: string, size: string>, "
    "streams: array<struct<codec_type: string, codec_name: string, width: string, height: string, r_frame_rate: string, avg_frame_rate: string, duration: string, bit_rate: string, nb_frames: string, pix_fmt: string>>>"
)
SEGMENTS = "video_id string, source_video_path string, segment_length_seconds double, segments array<struct<segment_id: int, start_seconds: double, end_seconds: double, duration_seconds: double, is_complete: boolean, expected_sample_count: int>>"
FRAMES = "video_id string, frames array<struct<segment_id: int, frame_index: int, timestamp_seconds: double, frame_path: string, success: boolean, error: string>>"
METADATA = "file_name string, absolute_path string, file_size_bytes bigint, duration_seconds double, width int, height int, resolution string, average_frame_rate string, frame_rate_fps double, codec_name string, codec_long_name string, pixel_format string, bitrate bigint, container_format string, number_video_streams int, number_audio_streams int, estimated_frame_count bigint, can_open_successfully boolean, extraction_timestamp string"
VALIDATION = "source_count bigint, video_count bigint, valid_video_count bigint, corrupt_video_count bigint, category_counts struct<reference: bigint, benign: bigint, tampered: bigint>"
RECORD = "schema_version string, video_id string, payload string, payload_sha256 string, algorithm string, key_id string, key_fingerprint string, tag string"


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below root: path, folder, name, size, and on request the content's SHA-256 with an error, which is null if it could be read. Spark's scan leaves out empty and hidden files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    listed = found.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("size"))
    return hashed(listed) if content else listed


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that pyarrow opens for a path or URI, and the path in it."""
    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/%@"))


def file_digest(path: str, size: int = 1 << 20) -> str:
    """SHA-256 of a file of any length, read in pieces, from any file system that pyarrow opens by its URI."""
    system, inner = file_system(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inner, buffer_size=0) as stream:
        while piece := stream.read(size):
            digest.update(piece)
    return digest.hexdigest()


def hashed(listed: DataFrame) -> DataFrame:
    """Listed files with sha256 and error. Executors open the paths and hold one piece of a file at a time, so a file may be larger than a row can."""
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[[k]].copy()
                try:
                    row["sha256"], row["error"] = file_digest(row["path"].iloc[0]), None
                except (OSError, ValueError) as e:
                    row["sha256"], row["error"] = None, str(e)
                yield row

    shape = StructType([*listed.schema, *StructType.fromDDL("sha256 string, error string")])
    return listed.repartition(parts, "path").mapInPandas(run, shape)


def supported(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos, skipped with `reason`): hidden files and other extensions are skipped."""
    known = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*S.VIDEO_EXTENSIONS)
    reason = F.when(F.col("filename").startswith("."), "hidden").when(~known, "unsupported extension")
    return found.filter(reason.isNull()), found.withColumn("reason", reason).filter("reason is not null")


def choose_references(videos: DataFrame) -> DataFrame:
    """Per folder the reference: the stem is the folder's name, else 'original'; .mp4 goes first. Other than one blocks the source."""
    stem, mp4 = F.lower(S.file_stem(F.col("filename"))), F.lower(S.file_extension(F.col("filename"))) == ".mp4"
    rank = F.when(stem == F.lower("folder"), F.when(mp4, 0).otherwise(1)).when(stem == "original", F.when(mp4, 2).otherwise(3))
    ranked = videos.withColumn("_rank", rank).filter("_rank is not null")
    best = ranked.withColumn("_class", F.floor(F.col("_rank") / 2)).withColumn("_best", F.min("_rank").over(Window.partitionBy("folder"))).filter("_rank = _best")
    chosen = best.groupBy("folder").agg(F.count(F.lit(1)).alias("candidates"), F.min("filename").alias("reference"))
    every = videos.select("folder").distinct().join(chosen, "folder", "left")
    return every.select("folder", F.when(F.col("candidates") == 1, F.col("reference")).alias("reference"), F.when(F.col("candidates") == 1, "valid").otherwise("blocked").alias("status"))


def probe_fields(text: Column, lenient: bool = False) -> list[Column]:
    """Fields of probe JSON. The stream's duration and bit rate stand in for the format's where these are missing; lenient: or 0."""
    p = F.from_json(text, PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 0)
    some = (lambda c: F.nullif(c, F.lit(0.0))) if lenient else (lambda c: c)
    duration = F.coalesce(some(S.optional_float(p["format"]["duration"])), S.optional_float(video["duration"]))
    fps = F.coalesce(S.frame_rate(video["avg_frame_rate"]), S.frame_rate(video["r_frame_rate"]))
    frames = S.optional_int(video["nb_frames"])
    if lenient:
        frames = F.coalesce(frames, F.bround(duration * fps).cast("bigint"))
    return [
        duration.alias("duration"),
        F.coalesce(S.optional_int(p["format"]["bit_rate"]), S.optional_int(video["bit_rate"])).alias("bit_rate"),
        S.optional_int(video["width"]).alias("width"),
        S.optional_int(video["height"]).alias("height"),
        fps.alias("fps"),
        frames.alias("frame_count"),
        video["codec_name"].alias("codec"),
        video.isNotNull().alias("has_video"),
    ]


def probe(paths: DataFrame, tool: str = "ffprobe", timeout: int = 120) -> DataFrame:
    """path -> probe JSON or an error, on the executors; needs the tool there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    done = subprocess.run([tool, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, text=True, timeout=timeout)
                    out.append((path, done.stdout if done.returncode == 0 else None, done.stderr[-500:] or None))
                except (OSError, subprocess.SubprocessError) as e:
                    out.append((path, None, str(e)[-500:]))
            yield pd.DataFrame(out, columns=["path", "json", "error"])

    return paths.select("path").mapInPandas(run, "path string, json string, error string")


def decode_check(paths: DataFrame, tool: str = "ffmpeg", timeout: int = 3600) -> DataFrame:
    """path -> whether the whole file decodes, and the end of the error text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    done = subprocess.run([tool, "-v", "error", "-i", path, "-f", "null", "-"], capture_output=True, text=True, timeout=timeout)
                    out.append((path, done.returncode == 0 and not done.stderr.strip(), done.stderr[-500:]))
                except (OSError, subprocess.SubprocessError) as e:
                    out.append((path, False, str(e)[-500:]))
            yield pd.DataFrame(out, columns=["path", "decodes", "error"])

    return paths.select("path").mapInPandas(run, "path string, decodes boolean, error string")


def segment_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).option("multiLine", "true").json(path).select("video_id", "source_video_path", "segment_length_seconds", F.explode("segments").alias("s")).select("video_id", "source_video_path", "segment_length_seconds", "s.*")


def frame_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(successes in order, failures, keys that occur twice - which valid manifests do not have)."""
    rows = spark.read.schema(FRAMES).option("multiLine", "true").json(path).select("video_id", F.explode("frames").alias("f")).select("video_id", "f.*")
    ok, failed = rows.filter("success"), rows.filter("not success")
    keys = ["video_id", "segment_id", "frame_index", "timestamp_seconds", "frame_path"]
    return ok.orderBy("video_id", "segment_id", "frame_index"), failed, ok.groupBy(*keys).count().filter("count > 1")


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("multiLine", "true").json(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stored metadata, one JSON object a file; a file that is no such object is an error."""
    return spark.read.schema(METADATA).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def dataset_validation(spark: SparkSession, path: str) -> DataFrame:
    """Counts of a stored validation report; absent fields are null, and without a report there is no row."""
    names = {"source_count": "sources", "video_count": "total_videos", "valid_video_count": "valid_videos", "corrupt_video_count": "corrupt"}
    try:
        rows = spark.read.schema(VALIDATION).option("multiLine", "true").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], VALIDATION)
    return rows.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.col(f"category_counts.{c}").alias(c) for c in ("reference", "benign", "tampered")))


def npz(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of NPZ files, one row a file and array: dtype, shape and values as doubles (null for text); no pickled objects. A worker holds one file and one array at a time; values pass as Arrow buffers."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    shape = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def row(path: str, name: str, v: np.ndarray) -> pa.RecordBatch:
        flat = v.ravel().astype(np.float64) if v.dtype.kind in "biuf" else None
        values = pa.nulls(1, pa.list_(pa.float64())) if flat is None else pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([str(v.dtype)]), pa.array([list(v.shape)], pa.list_(pa.int64())), values], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path"), batch.column("content")):
                with np.load(pa.BufferReader(content.as_buffer()), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        yield row(p.as_py(), name, arrays[name])

    return found.mapInArrow(run, "path string, name string, dtype string, shape array<long>, values array<double>")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a schema; a missing file gives an empty table."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def artifact(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """One stored artifact; a missing one is an error at run time."""
    found = spark.read.parquet(path).filter(F.col(key) == value)
    if found.limit(1).count() == 0:
        raise KeyError(f"{key} {value} is not stored in {path}")
    return found


def checked_features(rows: DataFrame, vector: str, size: int, clip: float = 5.0) -> DataFrame:
    """Rows that break a rule for normalized features, with the rule; valid input gives none."""
    v = F.col(vector)
    rule = F.when(v.isNull() | (F.size(v) != size), "shape").when(~F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), "finite").when(F.exists(v, lambda x: F.abs(x) > clip + 1e-6), "range")
    return rows.withColumn("rule", rule).filter("rule is not null")


@dataclasses.dataclass(frozen=True)
class Config:
    """Parameters of a run; values are checked when it is made."""

    segment_seconds: float = 5.0
    sample_fps: float = 1.0
    temporal_fps: float = 4.0
    clip: float = 5.0
    epsilon: float = 1e-8
    timestamp_tolerance_us: int = 1000
    resnet_weight: float = 0.5
    temporal_weight: float = 0.5
    keep_partial: bool = False

    def __post_init__(self) -> None:
        if min(self.segment_seconds, self.sample_fps, self.temporal_fps, self.clip, self.epsilon) <= 0:
            raise ValueError("lengths, rates, clip and epsilon are positive")
        if self.timestamp_tolerance_us < 0 or min(self.resnet_weight, self.temporal_weight) < 0:
            raise ValueError("tolerance and weights are not negative")
        if abs(self.resnet_weight + self.temporal_weight - 1) > 1e-9:
            raise ValueError("weights sum to 1")

    @classmethod
    def load(cls, path: str, **overrides) -> Config:
        """From a JSON file (or YAML where a YAML library is installed); overrides win; unknown fields are errors."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            values = json.loads(text)
        except ValueError:
            import yaml

            values = yaml.safe_load(text)
        return cls(**{**values, **{k: v for k, v in overrides.items() if v is not None}})
