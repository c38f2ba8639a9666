"""Stored tables that are verified when they are read: data, digest tree and manifest in one folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.operators import identity


class IntegrityError(ValueError):
    """What was read is not what was stored, or breaks a rule of its kind."""


def write(df: DataFrame, folder: str, kind: str, identifier: str, key: list[str], parameters: dict | None = None, levels: int = identity.LEVELS) -> None:
    """data, tree and manifest; an existing artifact is not replaced."""
    df.write.mode("errorifexists").parquet(f"{folder}/data")
    stored = df.sparkSession.read.parquet(f"{folder}/data")
    identity.tree(stored, key, levels).coalesce(1).write.parquet(f"{folder}/tree")
    root = df.sparkSession.read.parquet(f"{folder}/tree").filter("level = 0")
    told = {"kind": kind, "identifier": identifier, "schema": stored.schema.jsonValue(), "key": key, "levels": levels, "parameters": parameters or {}}
    text = json.dumps(told, sort_keys=True, separators=(",", ":"), allow_nan=False)
    root.select(F.lit(text).alias("manifest"), "rows", "digest", F.sha2(F.concat_ws("\n", F.lit(text), F.col("rows").cast("string"), "digest"), 256).alias("seal")).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest with rows and digest; an error if it was changed."""
    row = spark.read.parquet(f"{folder}/manifest").withColumn("_seal", F.sha2(F.concat_ws("\n", "manifest", F.col("rows").cast("string"), "digest"), 256)).first()
    if row is None or row["seal"] != row["_seal"]:
        raise IntegrityError(f"the manifest of {folder} was changed")
    return json.loads(row["manifest"]) | {"rows": row["rows"], "digest": row["digest"]}


def read(spark: SparkSession, folder: str, kind: str, identifier: str, digest: str | None = None, rules: Callable[[DataFrame, dict], DataFrame] | None = None) -> DataFrame:
    """The table, if its kind, identifier, columns, digest (also the expected one, where given) and rules hold; else an error that names the leaves or rows."""
    told = manifest(spark, folder)
    for name, wanted in (("kind", kind), ("identifier", identifier), *([("digest", digest)] if digest else [])):
        if told[name] != wanted:
            raise IntegrityError(f"{folder}: {name} is {told[name]}, not {wanted}")
    df = spark.read.parquet(f"{folder}/data")
    if df.schema.jsonValue() != told["schema"]:
        raise IntegrityError(f"{folder}: the columns differ from the manifest's")
    found = identity.tree(df, told["key"], told["levels"])
    root = found.filter("level = 0").first()
    if (root["rows"], root["digest"]) != (told["rows"], told["digest"]):
        leaves = identity.differing(spark.read.parquet(f"{folder}/tree"), found, told["levels"]).orderBy("node").limit(20).collect()  # a report
        raise IntegrityError(f"{folder}: rows changed in " + ", ".join(f"{r['node']} ({r['rows_stored']} stored, {r['rows_found']} found)" for r in leaves))
    if rules is not None:
        broken = rules(df, told).limit(20).collect()  # a report
        if broken:
            raise IntegrityError(f"{folder}: " + ", ".join(f"{r['rule']} at {r['place']}" for r in broken))
    return df


def broken_vectors(df: DataFrame, by: list[str], vector: str, size: int, clip: float | None = None, order: str = "segment_id") -> DataFrame:
    """(place, rule): rows whose vector has another size, holds null, NaN or infinity or exceeds the clip range by more than 1e-6; repeated and negative places."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rule = F.when(v.isNull() | (F.size(v) != size), "size").when(bad, "not finite")
    if clip is not None:
        rule = rule.when(F.exists(v, lambda x: F.abs(x) > clip + 1e-6), "beyond the clip range")
    before = F.lag(order).over(Window.partitionBy(*by).orderBy(order))
    rule = rule.when(F.col(order).isNull() | (F.col(order) < 0), "no place").when(before == F.col(order), "repeated place")
    return df.select(F.to_json(F.struct(*by, order), {"ignoreNullFields": "false"}).alias("place"), rule.alias("rule")).filter("rule is not null")


def write_normalized(df: DataFrame, folder: str, video_id: str, calibration_id: str, by: list[str], vector: str = "x", clip: float = 5.0) -> None:
    """Normalized vectors of a recording with the calibration that made them."""
    write(df, folder, "normalized", video_id, [*by, "segment_id"], {"calibration_id": calibration_id, "by": by, "vector": vector, "clip": clip})


def read_normalized(spark: SparkSession, folder: str, video_id: str, size: int, calibration_id: str | None = None) -> DataFrame:
    """Verified normalized vectors; they must belong to the calibration, where one is given."""

    def rules(df: DataFrame, told: dict) -> DataFrame:
        p = told["parameters"]
        if not p["calibration_id"] or calibration_id and p["calibration_id"] != calibration_id:
            raise IntegrityError(f"{folder}: calibration is {p['calibration_id']}, not {calibration_id}")
        return broken_vectors(df, p["by"], p["vector"], size, p["clip"])

    return read(spark, folder, "normalized", video_id, rules=rules)


def write_quantizer(model: DataFrame, folder: str, quantization_id: str, normalization_id: str, normalization_digest: str) -> None:
    """A fitted quantizer (one row of arrays) with the identity of the normalization it was made for."""
    write(model.withColumn("pos", F.lit(0)), folder, "quantizer", quantization_id, ["pos"], {"normalization_id": normalization_id, "normalization_digest": normalization_digest})


def read_quantizer(spark: SparkSession, folder: str, quantization_id: str, normalization_id: str | None = None) -> DataFrame:
    """A verified quantizer: quartiles in order and finite, scales positive, all of one length."""

    def rules(df: DataFrame, told: dict) -> DataFrame:
        if normalization_id and told["parameters"]["normalization_id"] != normalization_id:
            raise IntegrityError(f"{folder}: normalization is {told['parameters']['normalization_id']}, not {normalization_id}")
        parts = ("q1", "median", "q3", "scale")
        finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        ordered = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)
        lengths: Column = F.size("q1") == F.size("median")
        rule = F.when(~(lengths & (F.size("q1") == F.size("q3")) & (F.size("q1") == F.size("scale"))), "lengths differ")
        for c in parts:
            rule = rule.when(~finite(c), f"{c} is not finite")
        rule = rule.when(~(ordered("q1", "median") & ordered("median", "q3")), "quartiles out of order").when(F.exists("scale", lambda x: x <= 0), "scale not positive")
        return df.select(F.lit(told["identifier"]).alias("place"), rule.alias("rule")).filter("rule is not null")

    return read(spark, folder, "quantizer", quantization_id, rules=rules).drop("pos")
