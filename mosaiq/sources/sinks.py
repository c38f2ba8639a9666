"""Writers: tables, staged tables, CSV of mixed rows, logs, table bundles, and the content-addressed cache."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import identity


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where none is set, a temporary folder, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: later plans start from the files."""
    path = f"{shared_folder(df.sparkSession)}/mosaiq/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> None:
    """An existing table is replaced only on request."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def null_nan(df: DataFrame, strict: bool = False) -> DataFrame:
    """NaN and infinity become null, or are an error with strict."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        bad = F.isnan(c) | (F.abs(c) == float("inf")) if kind in ("double", "float") else None
        out.append(c if bad is None else F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind) if strict else F.lit(None).cast(kind)).otherwise(c).alias(name))
    return df.select(*out)


def flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, for CSV."""
    return df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes))


def write_csv(parts: list[DataFrame], path: str, overwrite: bool = False, gzip: bool = False) -> None:
    """The union of the parts with the columns in order of first appearance."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(flat, parts))
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').option("compression", "gzip" if gzip else "none").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_bundle(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    for name, df in tables.items():
        write_csv([df], f"{folder}/{name}", overwrite)


def cache_key(df: DataFrame, fields: list[str]) -> DataFrame:
    """key: SHA-256 of the fields' canonical JSON."""
    return df.withColumn("cache_key", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))


def work_list(inputs: DataFrame, manifest: DataFrame, key: str = "video_id") -> DataFrame:
    """Inputs without a stored artifact. A stored one with another cache key is an error, not a recomputation."""
    m = manifest.select(key, F.col("cache_key").alias("_stored"))
    joined = inputs.join(m, key, "left")
    clash = F.col("_stored").isNotNull() & (F.col("_stored") != F.col("cache_key"))
    checked = joined.withColumn("_stored", F.when(clash, F.raise_error(F.concat(F.lit("cache key differs for "), F.col(key).cast("string")))).otherwise(F.col("_stored")))
    return checked.filter(F.col("_stored").isNull()).drop("_stored")


def checksum(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a SHA-256 digest, equal for equal rows in any order and partitioning; 0 for an empty table."""
    return identity.table_identity(df).select("rows", F.when(F.col("rows") == 0, "0").otherwise(F.col("digest")).alias("checksum"))


def manifest(artifacts: dict[str, DataFrame], source: str, parameters: dict, warnings: list[str] = []) -> DataFrame:
    """Provenance of stored tables: a row each with its rows, checksum, columns, source, parameters and warnings."""
    text = json.dumps(parameters, sort_keys=True, separators=(",", ":"), allow_nan=False)
    told = F.array(*map(F.lit, warnings)) if warnings else F.array().cast("array<string>")
    rows = [checksum(df).select(F.lit(name).alias("artifact"), "rows", "checksum", F.lit(df.schema.simpleString()).alias("columns"), F.lit(source).alias("source"), F.lit(text).alias("parameters"), told.alias("warnings"), F.current_timestamp().alias("created")) for name, df in artifacts.items()]
    return reduce(DataFrame.unionByName, rows)


def changed(artifacts: dict[str, DataFrame], stored: DataFrame) -> DataFrame:
    """Artifacts whose rows, checksum or columns differ from the stored manifest's, or that it lacks; none if all is well."""
    now = manifest(artifacts, "", {}).select("artifact", *(F.col(c).alias(f"_{c}") for c in ("rows", "checksum", "columns")))
    joined = now.join(stored, "artifact", "left")
    reason = F.when(F.col("rows").isNull(), "not in the manifest").when(F.col("columns") != F.col("_columns"), "columns").when(F.col("rows") != F.col("_rows"), "rows").when(F.col("checksum") != F.col("_checksum"), "checksum")
    return joined.select("artifact", reason.alias("reason")).filter("reason is not null")


def inspect(table: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    """A read-only view of one stored recording; filter and columns reach the scan."""
    return table.filter(F.col(key) == value).select(key, *columns)
