"""Logical tables of the engine derived from the shared test tables (see FIXTURES.md part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions.scalars import TRANSFORMATIONS, category_of, expected_label

#: Sizes of the three streams of a segment vector.
RESNET, TEMPORAL, SPATIAL = 40, 12, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("rn", F.row_number().over(order) - 1)
    source = F.concat(F.lit("SRC_"), F.col("label").cast("string"))
    number = F.col("rn") % 9
    named = rows.select(
        source.alias("source_id"),
        F.concat(source, F.lit("_V"), number.cast("string")).alias("video_id"),
        number.cast("int").alias("video_no"),
        F.element_at(F.lit(list(TRANSFORMATIONS)), (number + 1).cast("int")).alias("transformation"),
        F.floor(F.col("rn") / 9).cast("int").alias("segment_id"),
        F.slice("embedding", 1, RESNET).alias("resnet"),
        F.slice("embedding", RESNET + 1, TEMPORAL).alias("temporal"),
        F.slice("embedding", RESNET + TEMPORAL + 1, SPATIAL).alias("spatial"),
    )
    kinds = F.element_at(F.lit([".mp4:source_res", ".avi:source_res", ".mov:source_res", ".mp4:480p", ".mp4:720p", ".mp4:source_res", ".mp4:480p", ".mp4:720p", ".mkv:unknown_res"]), F.col("video_no") + 1)
    return named.withColumn("profile", kinds).withColumn("category", category_of(F.col("transformation"))).withColumn("expected", expected_label(F.col("transformation")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = e.withColumn("segment_id", day).withColumn("frame_index", F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id")) - 1)
    return e.select(
        F.col("user_id").alias("video_id"),
        "segment_id",
        "frame_index",
        F.col("ts").alias("ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"),
        "value",
        (F.col("event_type") != "error").alias("success"),
        F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 15), 16, 10).cast("bigint").alias("hash64"),
    )


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 pixels in [0, 1] from the vectors: a label is a recording, nine vectors a segment."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("rn", F.row_number().over(order) - 1)
    pixels = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 1) / 2)))
    return rows.select(F.col("label").alias("video_id"), F.floor(F.col("rn") / 9).cast("int").alias("segment_id"), (F.col("rn") % 9).cast("int").alias("frame_index"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 5_000_000 + (F.length("text") % 3) * 1000
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment_id"), start.alias("start_us"), (start + 5_000_000).alias("end_us"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("video_id"),
        F.col("lang").alias("transformation"),
        F.when(F.col("toxic") == 1, "abnormal").otherwise("normal").alias("expected"),
        F.when(F.col("quality") == 0, "abnormal").otherwise("normal").alias("observed"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of recordings: one row a document; paths, sizes and frame rates by rule."""
    docs = table(spark, sf_dir, "documents")
    kind = (F.col("doc_id") % 11).cast("int")
    names = ["original.mp4", "take_avi.avi", "take.mov", "clip_480p.mp4", "clip_720.mp4", "blurred.mp4", "frame_del_x.mp4", "insert-1.mp4", "swap.mp4", "blur_480.mp4", "other.mkv"]
    rates = ["30/1", "30000/1001", "25/1", "invalid", "0/0", "24"]
    return docs.select(
        F.concat(F.lit("SRC_"), F.upper("source")).alias("source_id"),
        F.col("doc_id").alias("video_id"),
        F.element_at(F.lit(names), kind + 1).alias("filename"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.when(F.col("doc_id") % 7 != 0, 320 + (F.col("doc_id") % 13) * 100).cast("int").alias("width"),
        (240 + (F.col("doc_id") % 5) * 150).cast("int").alias("height"),
        F.element_at(F.lit(rates), (F.col("doc_id") % 6).cast("int") + 1).alias("fps_text"),
    )


def runtime_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("run_id"),
        F.col("l_linestatus").alias("source_id"),
        F.col("o_orderpriority").alias("video_id"),
        F.col("l_returnflag").alias("stage"),
        F.when(F.col("l_discount") > 0.05, "failed").otherwise("completed").alias("status"),
        (F.col("l_tax") < 0.02).alias("cache_reused"),
        F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("duration_text"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("seq"),
    )
