import json

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.operators import stream_records as R

KEY = auth.demonstration_key()
PRINT = auth.key_fingerprint(KEY)


def signed(spark, bits=8):
    rows = [("S", "vé\"1", s, [1, 0] * (bits // 2), [1, 1, 0], s * 5.0, s * 5.0 + 5) for s in (10, 2, 0)]
    d = spark.createDataFrame(rows, "source_id string, video_id string, segment_id int, a array<int>, b array<int>, start_s double, end_s double")
    p = R.payloads(d, {"a": "a", "b": "b"}, {"a": 8, "b": 3}, {}, "p", F.lit("n"), F.lit("q"), F.lit("h"))
    return R.build(p, "k", PRINT, "file", len(KEY), auth.DEMONSTRATION)


def test_record_is_canonical_and_holds_all_streams(spark):
    row = signed(spark).first()
    record = json.loads(row["record"])
    p = record["payload"]
    assert auth.canonical_text(p) == row["payload"] and list(record["authentication"]) == sorted(record["authentication"])
    assert [s["segment_id"] for s in p["segments"]] == [0, 2, 10]
    assert p["segments"][1] == {"a_packed_digest_hex": "aa", "b_packed_digest_hex": "c0", "hybrid_packed_digest_hex": "aac0", "segment_id": 2, "start_time_microseconds": 10000000, "end_time_microseconds": 15000000}
    assert p["stream_boundaries"] == {"a": {"start": 0, "end_exclusive": 8}, "b": {"start": 8, "end_exclusive": 11}}
    assert p["digest_lengths"] == {"a": 8, "b": 3, "hybrid": 11} and p["segment_count"] == 3


def test_digest_of_another_length_is_an_error(spark):
    with pytest.raises(Exception, match="stream a has not 8 bits"):
        signed(spark, 6).collect()


def test_every_change_is_seen_and_layout_is_not(spark):
    record = json.loads(signed(spark).first()["record"])
    texts = [json.dumps(record, indent=2)]
    for field in record["payload"]:
        texts.append(json.dumps({**record, "payload": {**record["payload"], field: "x"}}))
    checked = R.verify(spark.createDataFrame(list(enumerate(texts)), "n int, record string"), PRINT, auth.DEMONSTRATION).orderBy("n").collect()
    assert checked[0]["record_valid"] and checked[0]["failure_reason"] is None and checked[0]["record_video_id"] == 'vé"1'
    assert not any(r["record_valid"] or r["payload_checksum_valid"] or r["hmac_valid"] for r in checked[1:])


@pytest.mark.parametrize("text", [None, "", "{", "[]", "3", "{}", '{"payload": {}}', '{"payload": "{}", "authentication": {}}', '{"payload": {"x": NaN}, "authentication": {}}', '{"payload": {"schema_version": "two"}, "authentication": {}}', '{"payload": {"schema_version": [2]}, "authentication": {}}', '{"payload": {"schema_version": Infinity}, "authentication": {}}'])
def test_malformed_records_are_rows_of_false(spark, text):
    row = R.verify(spark.createDataFrame([(text,)], "record string"), PRINT, auth.DEMONSTRATION).first()
    assert not any(row[f] for f in R.FLAGS) and not row["record_valid"]
    assert row["failure_reason"].startswith((R.NO_OBJECTS, "malformed canonical payload"))


def test_empty_table(spark):
    none = spark.createDataFrame([], "record string, extra int")
    assert R.verify(none, PRINT, auth.DEMONSTRATION).count() == 0
