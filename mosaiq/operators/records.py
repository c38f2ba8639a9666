"""Authentication records: canonical payloads of a recording's digests, signing, checking and the gate before a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.functions import scalars as S
from mosaiq.functions import vectors as V

SCHEMA_VERSION = "1"


def payloads(digests: DataFrame, keys: list[str] = ["source_id", "video_id"], bits: str = "bits") -> DataFrame:
    """One canonical JSON payload a recording; its segments in order with times in microseconds and digests in hex."""
    segment = F.struct(F.col("segment_id"), F.col("digest"), F.col("end_us"), F.col("start_us"))
    rows = digests.select(*keys, "segment_id", V.hex_text(V.pack_bits(F.col(bits))).alias("digest"), S.microseconds(F.col("start_s")).alias("start_us"), S.microseconds(F.col("end_s")).alias("end_us"), F.size(bits).alias("n_bits"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(segment)).alias("s"), F.max("n_bits").alias("n_bits"))
    ordered = F.transform("s", lambda x: F.struct(x["digest"].alias("digest"), x["end_us"].alias("end_us"), x["segment_id"].alias("segment_id"), x["start_us"].alias("start_us")))
    payload = auth.canonical_json({"video_id": F.col("video_id"), "source_id": F.col("source_id"), "bits": F.col("n_bits"), "segments": ordered, "schema_version": F.lit(SCHEMA_VERSION)})
    return grouped.select(*keys, payload.alias("payload"))


def sign(rows: DataFrame, key_id: str, fingerprint: str, path: str | None = None, variable: str | None = None) -> DataFrame:
    return rows.select(
        "*",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(auth.ALGORITHM).alias("algorithm"),
        auth.payload_sha256(F.col("payload")).alias("payload_sha256"),
        F.lit(key_id).alias("key_id"),
        F.lit(fingerprint).alias("key_fingerprint"),
        auth.sign(F.col("payload"), path, variable).alias("tag"),
    )


def verify(records: DataFrame, fingerprint: str, path: str | None = None, variable: str | None = None) -> DataFrame:
    """A flag for each check and the reasons of failure; a malformed record fails, it is never an error."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "schema_ok": (ok(F.col("schema_version") == SCHEMA_VERSION), "unsupported schema"),
        "algorithm_ok": (ok(F.col("algorithm") == auth.ALGORITHM), "unsupported algorithm"),
        "payload_ok": (ok(F.sha2("payload", 256) == F.lower("payload_sha256")), "payload hash mismatch"),
        "key_ok": (ok(F.col("key_fingerprint") == fingerprint), "key fingerprint mismatch"),
        "tag_ok": (ok(auth.verify(F.col("payload"), F.col("tag"), path, variable)), "tag mismatch"),
    }
    out = records.select("*", *(c.alias(k) for k, (c, _) in flags.items()))
    valid = F.lit(True)
    for k in flags:
        valid = valid & F.col(k)
    return out.withColumn("valid", valid).withColumn("reasons", F.concat_ws("; ", *(F.when(~F.col(k), r) for k, (_, r) in flags.items())))


def gate(queries: DataFrame, verified: DataFrame, by: list[str] = ["source_id"]) -> DataFrame:
    """Only recordings whose reference record verifies may be compared."""
    return queries.join(verified.filter("valid").select(*by).distinct(), by, "left_semi")


def reusable(new: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """New payloads whose stored, valid record holds the same payload and key."""
    s = stored.filter("valid").select(key, F.col("payload").alias("_p"), F.col("key_fingerprint").alias("_f"))
    return new.join(s, key).filter(F.col("payload").eqNullSafe(F.col("_p")) & F.col("key_fingerprint").eqNullSafe(F.col("_f"))).drop("_p", "_f")
