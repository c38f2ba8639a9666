"""Bundles of named CSV tables with a manifest of their files, which `verify` holds against what is there.

A bundle has exactly the tables of its list. Every table is computed once, written to the shared folder, and from there to CSV:
nested cells as JSON text, nulls as empty cells. The manifest has a row a file: table, file, size, SHA-256, and of the table its
rows and columns; a table without rows has one row with null file. It is written last, so a folder without one is not a whole bundle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.sources import readers, sinks

# The tables of an evaluation over several sources.
MULTI_SOURCE = (
    "source_registry",
    "video_inventory",
    "metadata_comparison",
    "pipeline_status",
    "runtime_log",
    "segment_distances",
    "alignment_findings",
    "per_video_summary",
    "pooled_thresholds",
    "leave_one_source_out_thresholds",
    "diagnostic_predictions",
    "per_source_metrics",
    "per_tamper_metrics",
    "per_benign_metrics",
    "attribution_summary",
    "sha256_baseline",
    "runtime_summary",
    "failures",
)
MANIFEST = "_manifest"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """table, file, size and sha256 of the CSV files; an unreadable file has a null digest."""
    found = readers.files(spark, folder, content=True).filter(F.col("filename").startswith("part-"))
    return found.select(F.col("folder").alias("table"), F.col("filename").alias("file"), "size", "sha256")


def save(tables: dict[str, DataFrame], folder: str, names: tuple[str, ...] = MULTI_SOURCE, overwrite: bool = False) -> None:
    """Writes the bundle; tables that are missing or not of the list are an error before anything is written."""
    missing, more = sorted(set(names) - set(tables)), sorted(set(tables) - set(names))
    if missing or more:
        raise ValueError(f"tables missing: {missing}, not of the bundle: {more}")
    told = []
    for name in names:
        staged = sinks.stage_table(tables[name], f"bundle-{name}")
        sinks.write_csv([staged], f"{folder}/{name}", overwrite)
        told.append((name, staged.count(), ",".join(staged.columns)))
        sinks.drop_table(staged)
    spark = tables[names[0]].sparkSession
    about = spark.createDataFrame(told, "table string, rows long, columns string")
    about.join(_files(spark, folder), "table", "left").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{MANIFEST}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, all columns as text; cells may hold line breaks and quotes."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Files that differ from the manifest: table, file and reason (missing, changed, not in the manifest); none if the bundle is whole."""
    stored = manifest(spark, folder).filter("file is not null").select("table", "file", F.col("sha256").alias("_stored"), F.lit(True).alias("_listed"))
    found = _files(spark, folder).select("table", "file", "sha256", F.lit(True).alias("_there"))
    reason = F.when(F.col("_listed").isNull(), "not in the manifest").when(F.col("_there").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("_stored")), "changed")
    return stored.join(found, ["table", "file"], "full").select("table", "file", reason.alias("reason")).filter("reason is not null")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """A row a table: rows and columns of the manifest, rows read back, and files that differ from the manifest."""
    told = manifest(spark, folder)
    names = [r["table"] for r in told.select("table").distinct().collect()]  # a name a table
    read = reduce(DataFrame.unionByName, [load(spark, folder, n).agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(n).alias("table"), "rows_read") for n in names])
    wrong = verify(spark, folder).groupBy("table").agg(F.count(F.lit(1)).alias("wrong"))
    one = told.groupBy("table").agg(F.first("rows").alias("rows"), F.first("columns").alias("columns"))
    return one.join(read, "table").join(wrong, "table", "left").select("table", "rows", "rows_read", "columns", F.coalesce("wrong", F.lit(0)).cast("bigint").alias("files_wrong"))
