import json

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.operators import chain, nested, validation
from mosaiq.plans import catalog
from mosaiq.sources import adapters, readers, sinks

SF = "/root/testdata/sf0.001"
SEGMENT = "source_id string, video_id string, segment_id int, start_us bigint, end_us bigint, resnet_bits array<int>, temporal_bits array<int>"


def sides(spark):
    ref = [("s", "r", i, i * 5_000_000, (i + 1) * 5_000_000, [0, 0, 0, 0], [0, 0]) for i in range(3)]
    query = [
        ("s", "q", 0, 0, 5_000_000, [1, 0, 0, 0], [1, 1]),
        ("s", "q", 1, 5_002_000, 10_002_000, [0, 0, 0, 0], [0, 0]),
        ("s", "q", 3, 15_000_000, 20_000_000, [0, 0, 0, 0], [0, 0]),
    ]
    return spark.createDataFrame(ref, SEGMENT), spark.createDataFrame(query, SEGMENT)


def test_compare_gives_states_distances_and_attribution(spark):
    c = chain.compare(*sides(spark), ["source_id"], "video_id", {"resnet": 4, "temporal": 2})
    got = {r["segment_id"]: r for r in c.collect()}
    assert {k: r["state"] for k, r in got.items()} == {0: "matched", 1: "timestamp_mismatch", 2: "missing_in_query", 3: "extra_in_query"}
    r = got[0]
    assert (r["resnet_raw"], r["temporal_raw"], r["hybrid_raw"]) == (1, 2, 3)
    assert (r["resnet_distance"], r["temporal_distance"], r["hybrid_distance"], r["score"]) == (0.25, 1.0, 0.5, 0.625)
    assert (r["attribution"], r["attribution_code"]) == ("temporal_dominant", 2)
    assert got[1]["start_delta_us"] == 2000 and got[1]["score"] is None and got[1]["attribution"] is None
    assert (got[3]["ref_place"], got[3]["query_place"]) == (None, 2) and got[2]["query_place"] is None
    s = chain.structure(c, ["video_id"]).first()
    assert (s["matched"], s["findings"], s["structural"]) == (1, 3, True)
    m = chain.summary(c, ["video_id"], ["resnet", "temporal"]).first()
    assert (m["max_score"], m["segment_of_max_score"], m["temporal_dominant"], m["no_difference"]) == (0.625, 0, 1, 0)


def test_summary_without_matches_is_null(spark):
    ref, query = sides(spark)
    c = chain.compare(ref, query.filter("segment_id = 3"), ["source_id"], "video_id", {"resnet": 4, "temporal": 2})
    m = chain.summary(c, ["video_id"], ["resnet", "temporal"]).first()
    assert m["mean_score"] is None and m["segment_of_max_score"] is None and m["resnet_dominant"] == 0


def test_gate_names_the_first_obstacle(spark):
    cols = "source_id string, video_id string, quantization_id string, normalization_id string, bits int, boundaries string, bit_order string"
    q = spark.createDataFrame([("a", "a1", "q", "n", 6, "b", "big"), ("a", "a2", "x", "y", 6, "b", "big"), ("a", "a3", "q", "n", 6, "b", "little"), ("a", "a4", None, "n", 6, "b", "big"), ("b", "b1", "q", "n", 6, "b", "big"), ("c", "c1", "q", "n", 6, "b", "big")], cols)
    r = spark.createDataFrame([("a", True, "q", "n", 6, "b", "big"), ("b", False, "q", "n", 6, "b", "big")], "source_id string, valid boolean, quantization_id string, normalization_id string, bits int, boundaries string, bit_order string")
    got = {x["video_id"]: x["reason"] for x in chain.gate(q, r, ["source_id"]).collect()}
    assert got == {"a1": None, "a2": chain.GATED["quantization_id"], "a3": chain.GATED["bit_order"], "a4": chain.GATED["quantization_id"], "b1": "reference record does not verify", "c1": "reference record not found"}


def decided(spark, rows):
    return spark.createDataFrame(rows, "video_id string, segment_id int, resnet_distance double, temporal_distance double, score double, structural boolean")


def test_predictions_keep_recordings_without_segments(spark):
    reg = spark.createDataFrame([("s", "ok", "normal"), ("s", "bad", "abnormal"), ("s", "gone", "abnormal"), ("s", "cut", "abnormal"), ("s", "odd", "unknown")], "source_id string, video_id string, expected string")
    rows = decided(spark, [("ok", 0, 0.1, 0.1, 0.1, False), ("bad", 1, 0.6, 0.1, 0.2, False), ("bad", 0, 0.1, 0.6, 0.2, False), ("bad", 2, 0.3, 0.3, 0.5, False), ("cut", 0, 0.0, 0.0, 0.0, True), ("odd", 0, 0.0, 0.0, 0.0, False)])
    marked = chain.segment_attribution(rows, {s: F.lit(0.4) for s in ("resnet", "temporal", "balanced")})
    findings = spark.createDataFrame([("cut", 3), ("gone", 5)], "video_id string, findings bigint")
    got = {r["video_id"]: r for r in chain.predictions(reg, marked, findings).collect()}
    assert {k: r["observed"] for k, r in got.items()} == {"ok": "normal", "bad": "abnormal", "gone": "failed", "cut": "abnormal", "odd": "normal"}
    assert {k: r["correct"] for k, r in got.items()} == {"ok": True, "bad": True, "gone": False, "cut": True, "odd": False}
    assert got["bad"]["abnormal_segments"] == [0, 1, 2] and got["bad"]["main_attribution"] == "resnet_only"
    assert (got["cut"]["main_attribution"], got["gone"]["main_attribution"], got["ok"]["main_attribution"]) == ("structural", "none", "none")
    assert got["gone"]["max_score"] is None and got["gone"]["abnormal_segments"] == [] and got["gone"]["findings"] == 5


def test_missing_thresholds_leave_structure_only(spark):
    rows = decided(spark, [("a", 0, 0.9, 0.9, 0.9, False), ("b", 0, 0.9, 0.9, 0.9, True)])
    limits = {"resnet": F.lit(0.1), "temporal": F.lit(None).cast("double"), "balanced": F.lit(0.1)}
    got = {r["video_id"]: (r["abnormal"], r["label"]) for r in chain.segment_attribution(rows, limits).collect()}
    assert got == {"a": (False, "none"), "b": (True, "structural")}


def test_few_sources_are_insufficient(spark):
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    assert {(r["training_sources"], r["fold_status"]) for r in chain.fold_status(three).collect()} == {(2, "insufficient_sources")}


def test_nested_judges_recordings_without_segments(spark):
    rows = adapters.seg_vectors(spark, SF)
    registry = rows.select("source_id", "video_id", "expected").distinct()
    lost = registry.filter("video_id like '%V6'").orderBy("video_id").first()["video_id"]
    _, p = nested.evaluate(rows.filter(F.col("video_id") != lost), catalog._keep(spark), registry=registry)
    got = {r["video_id"]: r["observed"] for r in p.collect()}
    assert len(got) == registry.count() and got[lost] == "abnormal"


def test_suffixed_join_and_selection(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "k", 2)], "id string, kind string, score int")
    b = spark.createDataFrame([("x", None, 9)], "id string, kind string, score int")
    got = {r["id"]: (r["score"], r["score_summary"]) for r in chain.suffixed_join(a, b, ["id", "kind"]).collect()}
    assert got == {"x": (1, 9), "y": (2, None)}
    reg = spark.createDataFrame([("s", "r", "reference"), ("s", "v", "benign"), ("s", "w", "benign"), ("t", "r2", "reference")], "source_id string, video_id string, category string")
    assert {r["video_id"] for r in chain.selected(reg, "s", "v").collect()} == {"r", "v"}
    assert chain.selected(reg).count() == 4


def test_byte_copies_and_type_lists(spark):
    reg = spark.createDataFrame([("s", 1, "h", "trusted_reference", "reference"), ("s", 2, "h", "blur", "tampered"), ("s", 3, "k", "blur", "tampered"), ("t", 4, "h", "trusted_reference", "reference"), ("t", 5, "z", "ambiguous", "ambiguous")], "source_id string, video_id int, sha256 string, transformation string, category string")
    got = {r["video_id"]: (r["copies_in_source"], r["first_in_source"], r["equal_references"]) for r in chain.byte_copies(reg).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 0), 3: (0, 3, 0), 4: (0, 4, 1), 5: (0, 5, 0)}
    lists = {r["source_id"]: r for r in chain.source_lists(reg, ["blur", "avi_conversion"]).collect()}
    assert lists["s"]["duplicated"] == ["blur"] and lists["s"]["missing"] == ["avi_conversion"] and lists["t"]["ambiguous_files"] == 1


def test_guard_and_segment_selection(spark):
    p = spark.createDataFrame([("abnormal", "abnormal"), ("normal", "abnormal")], "expected string, observed string")
    assert validation.require(validation.confusion_guard(p, 2, 1, 0, 1, 0)).count() == 5
    with pytest.raises(Exception, match="rule broken: tn"):
        validation.require(validation.confusion_guard(p, 2, 1, 1, 1, 0)).collect()
    m = spark.createDataFrame([("v", 0, True, 5.0, 1.0), ("v", 1, False, 5.0, 1.0)], "video_id string, segment_id int, is_complete boolean, segment_length_seconds double, sample_fps double")
    assert [r["segment_id"] for r in validation.complete_segments(m).collect()] == [0]
    with pytest.raises(Exception, match="unexpected sampling"):
        validation.complete_segments(m, fps=2.0).collect()


def test_manifest_finds_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, v string").repartition(3)
    m = sinks.manifest({"t": a}, "source", {"b": 1, "a": 2}, ["note"])
    row = m.first()
    assert (row["rows"], row["parameters"], row["warnings"]) == (2, '{"a":2,"b":1}', ["note"])
    assert sinks.changed({"t": b}, m).count() == 0
    other = {"t": a.withColumn("v", F.lit("x"))}
    assert [(r["artifact"], r["reason"]) for r in sinks.changed(other | {"u": a}, m).orderBy("artifact").collect()] == [("t", "checksum"), ("u", "not in the manifest")]
    assert sinks.inspect(a, "id", 1, ["v"]).collect() == [(1, "x")]
    assert sinks.manifest({"e": a.limit(0)}, "", {}).first()["checksum"] == "0"


def test_metadata_and_validation_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"file_name": "a.mp4", "duration_seconds": 5.0, "width": None, "number_video_streams": 1}, indent=2))
    r = readers.metadata(spark, str(tmp_path / "m.json")).first()
    assert (r["file_name"], r["duration_seconds"], r["width"], r["number_video_streams"]) == ("a.mp4", 5.0, None, 1)
    (tmp_path / "v.json").write_text(json.dumps({"source_count": 2, "category_counts": {"benign": 4}}))
    v = readers.dataset_validation(spark, str(tmp_path / "v.json")).first()
    assert (v["sources"], v["benign"], v["corrupt"]) == (2, 4, None)
    assert readers.dataset_validation(spark, str(tmp_path / "none.json")).count() == 0


def test_key_in_output_is_found(spark):
    key = auth.demonstration_key().hex()
    rows = spark.createDataFrame([("clean",), (f"x {key.upper()} y",), (None,)], "value string")
    found = rows.select(auth.mentions_key(F.col("value"), auth.DEMONSTRATION).alias("m"))
    assert [r["m"] for r in found.collect()] == [False, True, False]
    assert key not in found._jdf.queryExecution().toString()


def test_nested_skips_inner_folds_of_one_source_and_joins_no_sets(spark):
    """Three sources: two remain for the outer fold and one for an inner one, which is skipped; the first parameters are taken."""
    rows = adapters.seg_vectors(spark, SF).filter("source_id in ('SRC_0', 'SRC_1', 'SRC_2')")
    selected, found = nested.evaluate(rows, catalog._keep(spark))
    got = {tuple(r) for r in selected.collect()}
    assert got == {(f"SRC_{i}", 0, 1.5, 0.0, 0.0) for i in range(3)}
    assert {r["held_out"] for r in found.collect()} == {"SRC_0", "SRC_1", "SRC_2"}
    plans = []
    nested.evaluate(rows, lambda df: plans.append(df._jdf.queryExecution().toString()) or catalog._keep(spark)(df))
    assert plans and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_models_in_blocks_give_the_same_decisions(spark, monkeypatch):
    rows = adapters.seg_vectors(spark, SF).filter("source_id < 'SRC_5'")
    once = [sorted(tuple(r) for r in df.collect()) for df in nested.evaluate(rows, catalog._keep(spark), adaptive=True)]
    monkeypatch.setattr(nested, "BLOCK_BYTES", 3 * 4 * 8 * 64)
    assert once == [sorted(tuple(r) for r in df.collect()) for df in nested.evaluate(rows, catalog._keep(spark), adaptive=True)]
