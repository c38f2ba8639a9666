"""Authentication records of several streams (record version 2): payload with a digest a stream and segment, record, check.

A record is one JSON text with the objects `payload` and `authentication`. The tag and the checksum are taken over the payload in
canonical form, so the order of keys and white space of a stored record do not matter. A text that is no such record gives a
row of false flags with the reason; it is never an error. Every input row gives one output row, repeated ones too.
"""

from __future__ import annotations

import json
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.functions import scalars as S
from mosaiq.functions import vectors as V

# Version, names of the record's fields and reasons, as stored records have them.
VERSION = 2
SCHEMA_TEXT = "V2 canonical payload plus HMAC-SHA-256 over sorted compact JSON bytes"
FLAGS = {
    "schema_valid": "schema mismatch",
    "algorithm_supported": "unsupported algorithm",
    "payload_checksum_valid": "payload checksum mismatch",
    "key_fingerprint_match": "key fingerprint mismatch",
    "hmac_valid": "HMAC tag mismatch",
}
NO_OBJECTS = "missing payload or authentication object"
OPENED = "payload string, video_id string, schema_ok boolean, algorithm string, checksum string, key_id string, fingerprint string, tag string, problem string"


def payloads(digests: DataFrame, streams: dict[str, str], dimensions: dict[str, int], bits_per: dict[str, int], pipeline: str, normalization: Column, quantization: Column, source_hash: Column, keys: list[str] = ["source_id", "video_id"]) -> DataFrame:
    """One canonical payload a recording. streams: name -> column of bits, in the order of the joined digest; dimensions and bits_per: values of a stream and bits of a value.

    A recording whose digest has not dimensions x bits_per bits in some stream is an error.
    """
    sizes = {s: dimensions[s] * bits_per.get(s, 1) for s in streams}
    ends = dict(zip(streams, accumulate(sizes.values())))
    checked = {s: F.when(F.size(c) == sizes[s], F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"stream {s} has not {sizes[s]} bits in "), F.col("video_id").cast("string"))).cast("array<int>")) for s, c in streams.items()}
    packed = {f"{s}_packed_digest_hex": V.hex_text(V.pack_bits(c)) for s, c in checked.items()}
    packed["hybrid_packed_digest_hex"] = V.hex_text(V.pack_bits(F.concat(*checked.values())))
    packed |= {"start_time_microseconds": S.microseconds(F.col("start_s")), "end_time_microseconds": S.microseconds(F.col("end_s")), "segment_id": F.col("segment_id")}
    told = [c.alias(n) for n, c in {"_norm": normalization, "_quant": quantization, "_hash": source_hash}.items()]
    rows = digests.select(*keys, *told, *(packed[c].alias(c) for c in sorted(packed)))
    segment = F.struct("segment_id", F.struct(*sorted(packed)).alias("s"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(segment)).alias("segments"), *(F.first(c).alias(c) for c in ("_norm", "_quant", "_hash")))
    numbers = lambda d: F.struct(*(F.lit(d[k]).alias(k) for k in sorted(d)))
    bounds = F.struct(*(F.struct(F.lit(ends[s]).alias("end_exclusive"), F.lit(ends[s] - sizes[s]).alias("start")).alias(s) for s in sorted(streams)))
    payload = auth.canonical_json(
        {
            "schema_version": F.lit(VERSION),
            "pipeline_id": F.lit(pipeline),
            "video_id": F.col("video_id"),
            "normalization_id": F.col("_norm"),
            "quantization_id": F.col("_quant"),
            "source_video_sha256": F.col("_hash"),
            "segment_count": F.size("segments"),
            "continuous_dimensions": numbers({s: dimensions[s] for s in streams} | {"combined": sum(dimensions[s] for s in streams)}),
            "digest_lengths": numbers(sizes | {"hybrid": sum(sizes.values())}),
            "stream_boundaries": bounds,
            "bit_order": F.lit("big"),
            "segments": F.transform("segments", lambda x: x["s"]),
            "development_only": F.lit(False),
        }
    )
    return grouped.select(*keys, payload.alias("payload"))


def build(rows: DataFrame, key_id: str, fingerprint: str, key_source: str, key_bytes: int, path: str | None = None, variable: str | None = None, created_at: Column | None = None) -> DataFrame:
    """rows (payload in canonical form) with `record`, its JSON text. created_at is the time of the run if not given."""
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if created_at is None else created_at
    fields = {
        "record_schema_version": F.lit(VERSION),
        "algorithm": F.lit(auth.ALGORITHM),
        "key_id": F.lit(key_id),
        "key_fingerprint": F.lit(fingerprint),
        "key_source_type": F.lit(key_source),
        "key_length_bytes": F.lit(key_bytes),
        "tag_hex": auth.sign(F.col("payload"), path, variable),
        "canonical_payload_sha256": auth.payload_sha256(F.col("payload")),
        "created_at": made,
        "hmac_schema": F.lit(SCHEMA_TEXT),
    }
    return rows.withColumn("record", F.concat(F.lit('{"authentication":'), auth.canonical_json(fields), F.lit(',"payload":'), F.col("payload"), F.lit("}")))


def open_record(text: str | None) -> tuple:
    """The parts of a record's text that the checks need; `problem` says why it cannot be checked."""
    try:
        record = json.loads(text or "null")
    except ValueError:
        record = None
    record = record if isinstance(record, dict) else {}
    payload, told = ({} if not isinstance(record.get(k), dict) else record[k] for k in ("payload", "authentication"))
    shown = [None if v is None else str(v) for v in (told.get("algorithm"), told.get("canonical_payload_sha256"), told.get("key_id"), told.get("key_fingerprint"), told.get("tag_hex"))]
    video = None if payload.get("video_id") is None else str(payload["video_id"])
    if not all(isinstance(record.get(k), dict) for k in ("payload", "authentication")):
        return None, video, False, *shown, NO_OBJECTS
    try:
        ok = int(payload.get("schema_version", -1)) == int(told.get("record_schema_version", -1)) == VERSION
        return auth.canonical_text(payload), video, ok, *shown, None
    except (TypeError, ValueError, OverflowError) as e:
        return None, video, False, *shown, f"malformed canonical payload: {e}"


def verify(records: DataFrame, fingerprint: str, path: str | None = None, variable: str | None = None, record: str = "record") -> DataFrame:
    """records with video_id and key_id as the record names them (record_video_id, record_key_id), a flag a check, record_valid and failure_reason (null if valid)."""

    @F.pandas_udf(OPENED)
    def opened(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([open_record(t) for t in texts], columns=[c.split()[0] for c in OPENED.split(", ")])

    o = {c.split()[0]: F.col("_opened")[c.split()[0]] for c in OPENED.split(", ")}
    supported = o["algorithm"] == auth.ALGORITHM
    checks = {
        "schema_valid": o["schema_ok"],
        "algorithm_supported": supported,
        "payload_checksum_valid": F.sha2(o["payload"], 256) == o["checksum"],
        "key_fingerprint_match": o["fingerprint"] == fingerprint,
        "hmac_valid": supported & auth.verify(o["payload"], o["tag"], path, variable),
    }
    usable = o["problem"].isNull()
    told = records.withColumn("_opened", opened(F.col(record)))
    out = told.select(*records.columns, "_opened", *(F.coalesce(usable & c, F.lit(False)).alias(n) for n, c in checks.items()))
    reasons = F.concat_ws("; ", *(F.when(~F.col(n), why) for n, why in FLAGS.items()))
    reason = F.when(usable, F.nullif(reasons, F.lit(""))).otherwise(o["problem"])
    return out.select("*", o["video_id"].alias("record_video_id"), o["key_id"].alias("record_key_id"), reason.alias("failure_reason")).withColumn("record_valid", F.col("failure_reason").isNull()).drop("_opened")
