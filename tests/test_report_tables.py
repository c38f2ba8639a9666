"""Report tables: missing folds, scores and runs, small groups and empty tables."""

import pytest

from mosaiq.operators import report_tables as T


def rows(df):
    return {tuple(r)[0]: r.asDict() for r in df.collect()}


def test_scores_without_a_fold_or_a_value_exceed_nothing(spark):
    scores = spark.createDataFrame([("s1", "a", 0.5, None), ("s1", "a", 0.7, 0.2), ("s2", "b", 0.9, 0.9), (None, "c", 0.9, 0.9)], "source_id string, video_id string, r double, t double")
    limits = spark.createDataFrame([("s1", "r", 0.6), ("s1", "t", 0.2)], "held_out string, stream string, threshold double")
    got = {r["video_id"]: r for r in T.scores_with_thresholds(scores, limits, {"r": "r", "t": "t"}, ["source_id", "video_id"]).collect()}
    assert (got["a"]["segments"], got["a"]["max_r"], got["a"]["mean_t"]) == (2, 0.7, 0.2)
    assert (got["a"]["r_exceeds"], got["a"]["t_exceeds"], got["a"]["r_threshold"]) == (True, False, 0.6)
    for v in "bc":
        assert (got[v]["r_threshold"], got[v]["r_exceeds"], got[v]["t_exceeds"]) == (None, False, False)
    assert T.scores_with_thresholds(scores.filter("false"), limits, {"r": "r"}, ["source_id"]).count() == 0
    with pytest.raises(Exception, match="thresholds repeat in fold s1"):
        T.thresholds_by_fold(limits.unionByName(limits), ["r", "t"]).collect()


def test_rates_leave_failed_rows_out(spark):
    df = spark.createDataFrame([("blur", "normal", "abnormal"), ("blur", "normal", "normal"), ("blur", "normal", None), ("cut", "abnormal", "failed"), ("cut", None, "normal")], "transformation string, expected string, observed string")
    got = rows(T.rates_by_transformation(df))
    assert (got["blur"]["evaluated"], got["blur"]["failed"], got["blur"]["false_rejection_rate"], got["blur"]["detection_rate"]) == (2, 1, 0.5, None)
    assert (got["cut"]["evaluated"], got["cut"]["failed"], got["cut"]["detection_rate"]) == (0, 1, None)
    assert T.rates_by_transformation(df.filter("false")).count() == 0


def test_completion_takes_the_last_run_and_keeps_recordings_that_never_ran(spark):
    log = spark.createDataFrame([("a", "one", "failed", 1), ("a", "one", "completed", 2), ("a", "two", "completed", 1), ("a", "two", "skipped", 2), ("x", "one", "completed", 1), ("b", "other", "completed", 1)], "video_id string, stage string, status string, seq int")
    videos = spark.createDataFrame([("a",), ("b",), ("b",)], "video_id string")
    got = rows(T.completion(log, videos, ["one", "two", "three"]))
    assert got == {"a": {"video_id": "a", "one": "OK", "two": "FAIL", "three": "NA"}, "b": {"video_id": "b", "one": "NA", "two": "NA", "three": "NA"}}
    assert T.completion(log.filter("false"), videos.filter("false"), ["one"]).count() == 0


def test_points_are_benign_or_all(spark):
    inventory = spark.createDataFrame([("a", "benign", 2_000_000, 1000, 1000), ("b", "tampered", None, None, 10), ("c", "benign", 1, 10_000, 1000), ("d", None, 1, 1, 1)], "video_id string, category string, bit_rate long, width int, height int")
    scores = spark.createDataFrame([("a", 0.5), ("b", None), ("c", None), ("d", 0.1)], "video_id string, s double")
    got = rows(T.rates_and_scores(inventory, scores, "s"))
    assert {k: (v["mbps"], v["score"], v["point_size"]) for k, v in got.items()} == {"a": (2.0, 0.5, 200.0), "c": (1e-6, 0.0, 300.0)}
    rest = rows(T.rates_and_scores(inventory.filter("video_id in ('b', 'd')"), scores, "s"))
    assert set(rest) == {"b", "d"} and (rest["b"]["mbps"], rest["b"]["score"], rest["b"]["point_size"]) == (0.0, 0.0, 30.0)
    assert T.rates_and_scores(inventory.filter("false"), scores, "s").count() == 0


def test_stability_against_plain_python(spark):
    values = {("s", v): [0.01 * ((v * 7 + k * 3) % 11) + (0.4 if (v, k) == (2, 1) else 0) for k in range(4)] for v in range(4)} | {("alone", 0): [0.9, 0.1]}
    df = spark.createDataFrame([(s, v, k, x, x / 2) for (s, v), xs in values.items() for k, x in enumerate(xs)], "source_id string, video_no int, segment_id int, x double, y double")
    got = {(r[0], r[1]): r for r in T.stability(df, {"x": ("x", 0.02), "y": ("y", 0.02)}, ["source_id"], "video_no").collect()}

    def limit(xs):
        middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        m = middle(xs)
        return min(1.0, max(0.0, max(xs) + max(3 * middle([abs(x - m) for x in xs]), 0.02)))

    assert set(got) == {("s", v) for v in range(4)}
    for v in range(4):
        others = [x for (s, w), xs in values.items() if s == "s" and w != v for x in xs]
        over = [k for k, x in enumerate(values["s", v]) if x > limit(others) or x / 2 > limit([o / 2 for o in others])]
        assert (got["s", v]["tested_segments"], got["s", v]["would_be_marked_abnormal"], got["s", v]["abnormal_segments"]) == (4, bool(over), over)
    assert got["s", 2]["abnormal_segments"] == [1]


def test_primary_table_of_two_methods(spark):
    df = spark.createDataFrame([("m", "s1", "abnormal", "abnormal"), ("m", "s1", "normal", "abnormal"), ("m", "s2", "normal", "normal"), ("n", "s1", "normal", "normal")], "method string, source_id string, expected string, observed string")
    confidence = spark.createDataFrame([("m", "accuracy", 0.4, 0.9)], "method string, metric string, low double, high double")
    got = rows(T.primary_table(df, confidence))
    m, n = got["m"], got["n"]
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["total"]) == (1, 1, 1, 0, 3)
    assert (m["accuracy_point_estimate"], m["accuracy_ci_lower"], m["accuracy_ci_upper"], m["accuracy_fold_mean"]) == (pytest.approx(2 / 3), 0.4, 0.9, 0.75)
    assert m["accuracy_fold_sd"] == pytest.approx(0.125**0.5) and n["accuracy_fold_sd"] is None
    assert (n["recall_point_estimate"], n["recall_ci_lower"], n["accuracy_ci_lower"]) == (None, None, None)
    assert T.primary_table(df.filter("false"), confidence).count() == 0
