import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.operators import compare, evaluation, pixels, records, reports, segments
from mosaiq.sources import readers, sinks


def test_segment_grid_and_samples(spark):
    v = spark.createDataFrame([("a", 5.0), ("b", 10.0), ("c", 17.8), ("d", 4.9), ("e", 0.0)], "video_id string, duration double")
    n = {r["video_id"]: r["count"] for r in segments.segment_grid(v).groupBy("video_id").count().collect()}
    assert n == {"a": 1, "b": 2, "c": 3}
    kept = segments.segment_grid(v, keep_partial=True).filter("not is_complete").collect()
    assert {(r["video_id"], r["segment_id"], r["end_s"]) for r in kept} == {("c", 3, 17.8), ("d", 0, 4.9)}
    t = segments.sample_times(segments.segment_grid(v.filter("video_id = 'a'")), 4.0).orderBy("sample_index").collect()
    assert [r["ts_s"] for r in t] == [0.125 + 0.25 * i for i in range(20)]
    t = segments.sample_times(segments.segment_grid(v.filter("video_id = 'a'")), 1.0).collect()
    assert sorted(r["ts_s"] for r in t) == [0.5, 1.5, 2.5, 3.5, 4.5]


FRAMES = "video_id int, segment_id int, frame_index int, ts_s double, value double, success boolean"


def test_pairs_never_bridge_failures(spark):
    f = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, True), (1, 0, 1, 1.0, 9.0, False), (1, 0, 2, 2.0, 4.0, True), (1, 0, 3, 3.0, 1.0, True), (1, 0, 4, 4.0, 4.0, True), (1, 1, 0, 5.0, 0.0, True)], FRAMES)
    pairs = segments.adjacent_pairs(f)
    got = [(r["pair_index"], r["ok"], r["change"]) for r in pairs.orderBy("pair_index").collect()]
    assert got == [(0, False, None), (1, False, None), (2, True, 3.0), (3, True, 3.0)]
    s = segments.pair_features(pairs).first()
    assert (s["expected_pairs"], s["decoded_pairs"], s["failed_pairs"], s["mean_change"], s["std_change"], s["max_change"]) == (4, 2, 2, 3.0, 0.0, 3.0)
    best = segments.largest_change(pairs).first()
    assert (best["pair_index"], best["middle_s"]) == (2, 2.5)
    assert [r["row_index"] for r in segments.successes(f.filter("segment_id = 0")).orderBy("frame_index").collect()] == [0, 1, 2, 3]


def test_vector_mean_std(spark):
    df = spark.createDataFrame([("v", [1.0, 2.0]), ("v", [3.0, 6.0])], "video_id string, e array<float>")
    r = segments.vector_mean_std(df, "e", ["video_id"]).first()
    assert r["combined"] == [2.0, 4.0, 1.0, 2.0]


def test_alignment_states(spark):
    def seg(*rows):
        return spark.createDataFrame(list(rows), "g int, segment_id int, start_us long, end_us long")

    ref = seg((1, 0, 0, 5), (1, 1, 5, 10), (2, 0, 0, 5), (2, 1, 5, 10), (3, 0, 0, 5))
    qry = seg((1, 1, 5, 10), (1, 2, 10, 15), (2, 1, 5, 10), (2, 0, 0, 5), (3, 0, 2001, 2006))
    got = {(r["g"], r["segment_id"]): r["state"] for r in compare.align(ref, qry, ["g", "segment_id"]).collect()}
    assert got == {(1, 0): "missing_in_query", (1, 1): "matched", (1, 2): "extra_in_query", (2, 0): "matched", (2, 1): "matched", (3, 0): "timestamp_mismatch"}
    s = {r["g"]: r["alignment_valid"] for r in compare.alignment_summary(compare.align(ref, qry, ["g", "segment_id"]), ["g"]).collect()}
    assert s == {1: False, 2: True, 3: False}
    assert compare.duplicates(ref.union(ref.limit(1)), ["g", "segment_id"]).count() == 1
    assert {r["side"] for r in compare.one_sided(ref, qry, ["g", "segment_id"]).collect()} == {"left", "right"}


def test_hash_scores(spark):
    h = "g int, segment_id int, frame_index int, hash64 long, success boolean, offset_s double"
    ref = spark.createDataFrame([(1, 0, i, 0, True, 0.0) for i in range(3)] + [(1, 1, 0, 0, True, 0.0), (1, 2, 0, 0, True, 0.0)], h)
    qry = spark.createDataFrame([(1, 0, 0, 1, True, 0.0), (1, 0, 1, 3, True, 0.0), (1, 0, 2, 15, True, 0.0), (1, 1, 0, 0, False, 0.0)], h)
    pairs = compare.hash_pairs(ref, qry, ["g", "segment_id", "frame_index"])
    s = {r["segment_id"]: r for r in compare.hash_segments(pairs, ["g"]).collect()}
    assert set(s) == {0, 1}
    assert s[0]["mean"] == pytest.approx((1 + 2 + 4) / 3 / 64) and s[0]["largest"] == 4 / 64 and s[1]["score"] is None
    assert s[0]["segment_valid"] and not s[1]["segment_valid"]
    structure = compare.hash_structure(ref, qry, ["g"])
    d = compare.hash_video_decision(compare.hash_segments(pairs, ["g"]), structure, ["g"], F.lit(0.9)).first()
    assert d["observed"] == "abnormal" and d["decision_reason"] == "missing or extra segment; unusable corresponding frame-hash evidence"


def test_hash_decisions_fail_closed(spark):
    h = "g int, segment_id int, frame_index int, hash64 long, success boolean, offset_s double"
    good = [(1, 0, i, 0, True, 0.0) for i in range(5)]
    cases = {
        1: (good, good[:4] + [(1, 0, 4, 0, False, 0.0)]),  # one failed frame beside four valid ones
        2: (good, []),  # no query at all
        3: (good, [(1, 0, i, 0, False, 0.0) for i in range(5)]),  # no valid pair
        4: (good, good + [(1, 1, 0, 0, True, 0.0)]),  # an extra segment
        5: (good, [(1, 0, i, -1, True, 0.0) for i in range(5)]),  # all bits differ
    }
    ref, qry = (spark.createDataFrame([(g, *r[1:]) for g, sides in cases.items() for r in sides[i]], h) for i in (0, 1))
    pairs = compare.hash_pairs(ref, qry, ["g", "segment_id", "frame_index"])
    got = {r["g"]: r for r in compare.hash_video_decision(compare.hash_segments(pairs, ["g"]), compare.hash_structure(ref, qry, ["g"]), ["g"], F.lit(0.5)).collect()}
    assert {g: r["observed"] for g, r in got.items()} == {1: "normal", 2: "abnormal", 3: "abnormal", 4: "abnormal", 5: "abnormal"}
    assert got[1]["decision_reason"] == "within threshold with complete valid structure"
    assert got[2]["decision_reason"] == "missing or extra segment; unusable corresponding frame-hash evidence"
    assert got[3]["decision_reason"] == "unusable corresponding frame-hash evidence"
    assert got[4]["decision_reason"] == "missing or extra segment"
    assert got[5]["decision_reason"] == "video score strictly exceeds threshold"


def test_threshold_strictness_and_fallbacks(spark):
    df = spark.createDataFrame([(0.0,), (1 / 64,), (2 / 64,)], "v double")
    assert evaluation.mad_threshold(df, "v", [], 1.5, 1 / 64).first()["threshold"] == pytest.approx(3.5 / 64)
    assert evaluation.mad_threshold(df.limit(1), "v", [], 1.5, 1 / 64).first()["threshold"] == pytest.approx(1 / 64)


def test_metrics_policies(spark):
    rows = [("a", "abnormal", "abnormal"), ("a", "abnormal", "abnormal"), ("b", "normal", "normal"), ("b", "normal", "abnormal"), ("c", "abnormal", "normal"), ("c", "normal", "failed")]
    df = spark.createDataFrame(rows, "source_id string, expected string, observed string")
    m = evaluation.metrics(evaluation.counts(df, [])).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"]) == (2, 1, 1, 1)
    assert m["accuracy"] == 0.6 and m["far"] == pytest.approx(1 / 3) and m["frr"] == 0.5
    by = {r["source_id"]: r for r in evaluation.metrics(evaluation.counts(df, ["source_id"])).collect()}
    assert by["a"]["specificity"] is None and by["a"]["balanced_accuracy"] is None and by["c"]["precision"] is None
    zero = {r["source_id"]: r for r in evaluation.metrics(evaluation.counts(df, ["source_id"]), zero=True).collect()}
    assert zero["a"]["specificity"] == 0.0 and zero["a"]["balanced_accuracy"] == 0.5
    v = {r["metric"]: r for r in evaluation.fold_variance(df).collect()}
    assert v["specificity"]["valid_folds"] == 1 and v["specificity"]["sd"] is None and v["specificity"]["undefined_folds"] == 2


def test_bootstrap_is_clustered_and_repeatable(spark):
    c = spark.createDataFrame([(0, 2, 1, 0, 0), (1, 0, 1, 1, 0), (2, 1, 0, 0, 1)], "cluster_no long, tp long, tn long, fp long, fn long")
    a = evaluation.bootstrap(c, evaluation.numpy_draws(spark, 50, 3)).orderBy("metric").collect()
    b = evaluation.bootstrap(c, evaluation.numpy_draws(spark, 50, 3)).orderBy("metric").collect()
    assert a == b
    draws = evaluation.hashed_draws(spark, 20, 3).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(draws) == 20 and {r["n"] for r in draws} == {3}


def test_folds_exclude_the_held_out_group(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "source_id string, v int")
    folds = evaluation.fold_rows(df, df.select("source_id"))
    assert folds.count() == 6
    assert {r["leaked_rows"] for r in evaluation.leakage(folds).collect()} == {0}


def test_attribution_order(spark):
    rows = [(True, 0.1, 0.1, True, True, True), (False, 0.1, 0.1, True, True, True), (False, 0.1, 0.1, False, False, True), (False, 0.1, 0.2, False, False, True), (False, 0.0, 0.0, False, False, False)]
    df = spark.createDataFrame(rows, "s boolean, r double, t double, ro boolean, to boolean, bo boolean")
    args = [F.col("s"), F.col("r"), F.col("t"), F.col("r"), F.col("ro"), F.col("to"), F.col("bo")]
    assert [r[0] for r in df.select(evaluation.attribution(*args)).collect()] == ["structural", "both_streams", "resnet_only", "temporal_only", "none"]
    assert [r[0] for r in df.select(evaluation.attribution(*args, tie="both_streams")).collect()][2] == "both_streams"


def test_records_detect_every_change(spark, tmp_path):
    path = str(tmp_path / "key")
    auth.write_key(path)
    fingerprint = auth.key_fingerprint(auth.load_key(path))
    d = spark.createDataFrame([("S", "v", i, [1, 0, 1], 5.0 * i, 5.0 * i + 5) for i in (1, 0)], "source_id string, video_id string, segment_id int, bits array<int>, start_s double, end_s double")
    p = records.payloads(d)
    payload = json.loads(p.first()["payload"])
    assert [s["segment_id"] for s in payload["segments"]] == [0, 1] and payload["segments"][0]["digest"] == "a0"
    assert p.first()["payload"] == json.dumps(payload, sort_keys=True, separators=(",", ":"))
    signed = records.sign(p, "k", fingerprint, path)
    sinks.save(signed, str(tmp_path / "records"))
    signed = spark.read.parquet(str(tmp_path / "records"))
    good = records.verify(signed, fingerprint, path)
    assert good.first()["valid"] and good.first()["reasons"] == ""
    assert records.reusable(signed, good).count() == 1
    for column in ("payload", "payload_sha256", "schema_version", "algorithm", "key_fingerprint", "tag"):
        for bad in (F.lit("00"), F.lit(None).cast("string")):
            r = records.verify(signed.withColumn(column, bad), fingerprint, path).first()
            assert not r["valid"] and r["reasons"], column
    assert records.gate(spark.createDataFrame([("S",), ("T",)], "source_id string"), good).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    for name in ("cam/cam.mp4", "cam/cam.avi", "cam/.hidden.mp4", "cam/notes.txt", "two/original.mp4", "none/x.mp4"):
        f = tmp_path / "media" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    found = readers.files(spark, str(tmp_path / "media"), content=True)
    videos, skipped = readers.supported(found)
    assert videos.count() == 4 and {r["filename"] for r in skipped.collect()} <= {".hidden.mp4", "notes.txt"}
    got = {r["folder"]: (r["reference"], r["status"]) for r in readers.choose_references(videos).collect()}
    assert got == {"cam": ("cam.mp4", "valid"), "two": ("original.mp4", "valid"), "none": (None, "blocked")}
    probe = '{"format":{"duration":"0","bit_rate":"N/A"},"streams":[{"codec_type":"audio"},{"codec_type":"video","width":"640","height":"360","avg_frame_rate":"25/1","duration":"9.9","bit_rate":"1000"}]}'
    df = spark.createDataFrame([(probe,), ("{}",)], "j string")
    a, none = df.select(*readers.probe_fields(F.col("j"))).collect()
    assert (a["duration"], a["bit_rate"], a["width"], a["fps"], a["has_video"], none["has_video"]) == (0.0, 1000, 640, 25.0, True, False)
    b = df.select(*readers.probe_fields(F.col("j"), lenient=True)).first()
    assert b["duration"] == 9.9 and b["frame_count"] == round(9.9 * 25)
    (tmp_path / "s.json").write_text(json.dumps({"video_id": "v", "segments": [{"segment_id": 0, "start_seconds": 0.0, "is_complete": True}]}))
    assert readers.segment_manifests(spark, str(tmp_path / "s.json")).first()["is_complete"]
    np.savez(tmp_path / "x.npz", a=np.arange(6, dtype=np.float32).reshape(2, 3))
    r = readers.npz(spark, str(tmp_path)).first()
    assert (r["name"], r["shape"], r["values"]) == ("a", [2, 3], [0, 1, 2, 3, 4, 5])
    x, y = spark.createDataFrame([(1, [1, 2])], "a int, n array<int>"), spark.createDataFrame([(2, "z")], "a int, b string")
    sinks.write_csv([x, y], str(tmp_path / "csv"), gzip=True)
    back = readers.csv_text(spark, str(tmp_path / "csv"))
    assert back.columns == ["a", "n", "b"] and {r["n"] for r in back.collect()} == {"[1,2]", None}
    assert readers.csv_table(spark, str(tmp_path / "missing"), "a int").count() == 0
    with pytest.raises(Exception):
        sinks.write_csv([x], str(tmp_path / "csv"))
    nan = spark.createDataFrame([(float("nan"), 1.0)], "x double, y double")
    assert tuple(sinks.null_nan(nan).first()) == (None, 1.0)
    with pytest.raises(Exception):
        sinks.null_nan(nan, strict=True).collect()
    with pytest.raises(ValueError):
        readers.Config(resnet_weight=0.9)
    (tmp_path / "c.json").write_text('{"sample_fps": 2}')
    assert readers.Config.load(str(tmp_path / "c.json"), temporal_fps=8.0).temporal_fps == 8.0


def test_cache_keys_give_the_work_list(spark):
    df = sinks.cache_key(spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, p int"), ["p"])
    assert sinks.work_list(df, df.filter("video_id = 'a'")).select("video_id").collect()[0][0] == "b"
    assert sinks.work_list(df, df).count() == 0
    changed = sinks.cache_key(spark.createDataFrame([("a", 9)], "video_id string, p int"), ["p"])
    with pytest.raises(Exception, match="cache key differs"):
        sinks.work_list(changed, df).collect()


def test_pixel_features(spark):
    r = np.random.default_rng(0)
    sharp = r.random((64, 64)).astype(np.float32)
    ladder = pixels.blur_ladder(sharp)
    values = [pixels.sharpness(x)[0, 0] for x in ladder]
    assert values == sorted(values, reverse=True)
    assert (pixels.pair_features(sharp, sharp) == 0).all()
    noise, cut = np.clip(sharp + 0.01, 0, 1), 1 - sharp
    assert pixels.pair_features(sharp, noise)[0, 0] < pixels.pair_features(sharp, cut)[0, 0]
    assert pixels.area_resize(np.ones((100, 37), np.float32)).shape == (224, 224)
    assert np.allclose(pixels.area_resize(np.full((448, 448), 0.25, np.float32)), 0.25)
    with pytest.raises(ValueError):
        pixels.gaussian(sharp, 4)
    df = spark.createDataFrame([(1, 8, 8, [float(i) for i in range(64)]), (2, 8, 8, [1.0])], "frame_id long, height int, width int, pixels array<float>")
    got = {r["frame_id"]: r for r in pixels.frame_sharpness(df, ["frame_id"]).collect()}
    assert got[1]["error"] is None and got[1]["tenengrad_sharpness"] > 0 and got[2]["error"]
    e = pixels.embed(df.filter("frame_id = 1"), "frame_id long", lambda: lambda images: np.array([[x.mean()] for x in images])).first()
    assert len(e["embedding"]) == 1


def test_reports(spark):
    log = spark.createDataFrame([("v", "a", "failed", 1), ("v", "a", "completed", 2)], "video_id string, stage string, status string, seq int")
    got = {r["stage"]: r["status"] for r in reports.stage_status(log, log, ["a", "b"]).collect()}
    assert got == {"a": "completed", "b": None}
    with pytest.raises(ValueError):
        reports.comparison_methods(log, ("sha256", "x"))
