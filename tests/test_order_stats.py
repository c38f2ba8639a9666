import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mosaiq.operators import evaluation, models, order_stats
from mosaiq.plans import catalog, chain, tables  # noqa: F401 - chain and tables register their queries

DATA = "/root/testdata/sf0.01"


def made(seed, n, kinds=4):
    """Ties, negative values, far outliers and uneven groups."""
    r = random.Random(seed)
    draw = [lambda: r.gauss(0, 1), lambda: float(r.randint(-3, 3)), lambda: r.choice([1e9, -1e9, 1e-12]) * r.random(), lambda: 0.1 * r.randint(0, 40)]
    return [(r.randrange(kinds), f"g{min(int(r.expovariate(0.5)), 5)}", draw[i % 4]()) for i in range(n)]


def folded(rows, by, leave_out):
    """Every set's values, by brute force."""
    groups = sorted({g for _, g, _ in rows})
    out = {}
    for k in {x[0] for x in rows}:
        for i, a in enumerate(groups):
            for b in groups[i:] if leave_out == 2 else [a]:
                out[k, a, b] = np.array([v for c, g, v in rows if c == k and g not in (a, b)])
    return out


@pytest.fixture
def small_tables(monkeypatch):
    """Ranges are refined several times although the tables are small."""
    monkeypatch.setattr(order_stats, "RANGES", 8)
    monkeypatch.setattr(order_stats, "GATHER", 5)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_quantiles_equal_percentile_to_the_bit(spark, small_tables, monkeypatch, broadcast):
    monkeypatch.setattr(order_stats, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame(made(1, 900), "k int, g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["k"]: (r["n"], r["q"], r["largest"]) for r in order_stats.quantiles(df, "v", ["k"], probs).collect()}
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", probs).alias("q"), F.max("v").alias("m"))
    assert got == {r["k"]: (r["n"], r["q"], r["m"]) for r in want.collect()}


@pytest.mark.parametrize("leave_out", [1, 2])
def test_sets_of_all_groups_but_some(spark, small_tables, leave_out):
    rows = made(2, 500)
    df = spark.createDataFrame(rows, "k int, g string, v double")
    got = {(r["k"], r["out_a"], r["out_b"]): r for r in order_stats.spread(df, "v", ["k"], group="g", leave_out=leave_out).collect()}
    want = folded(rows, ["k"], leave_out)
    assert got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert r["n"] == len(values)
        assert r["largest"] == values.max()
        assert r["median"] == pytest.approx(np.median(values), rel=1e-15, abs=0)
        assert r["mad"] == pytest.approx(np.median(np.abs(values - r["median"])), rel=1e-14, abs=0)


def test_empty_sets_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.25), ("b", None)], "g string, v double")
    got = {r["held_out"]: (r["n"], r["threshold"]) for r in evaluation.fold_thresholds(df, "v", [], 3.0, 0.01, "g", groups=["a", "b", "c"]).collect()}
    assert got == {"a": (0, 1.0), "b": (2, 0.875), "c": (2, 0.875)}
    nothing = df.filter("v > 9")
    assert [(r["n"], r["largest"], r["threshold"]) for r in evaluation.mad_threshold(nothing, "v", [], 3.0, 0.01).collect()] == [(0, None, 1.0)]
    assert evaluation.mad_threshold(nothing, "v", ["g"], 3.0, 0.01).count() == 0
    assert {r["threshold"] for r in evaluation.fold_thresholds(nothing, "v", [], 3.0, 0.01, "g", groups=["a", "b"]).collect()} == {1.0}


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_values_are_rejected(spark, bad):
    df = spark.createDataFrame([([1.0, bad],), ([1.0, 2.0],)], "v array<double>")
    with pytest.raises(PySparkException, match="finite"):
        models.fit(df, F.col("v"), []).collect()
    with pytest.raises(PySparkException, match="finite"):
        evaluation.mad_threshold(df.select(F.explode("v").alias("v")), "v", [], 3.0, 0.0).collect()


def test_fit_without_equals_fits_of_the_rest(spark):
    rows = catalog.A.seg_vectors(spark, DATA).filter("video_no <= 4 and source_id < 'SRC_6'").select("source_id", models.STREAMS[1])
    sources = sorted(r[0] for r in rows.select("source_id").distinct().collect())
    got = {(r["out_a"], r["out_b"]): r for r in models.fit_without(rows, F.col("temporal"), "source_id", sources, 2).collect()}
    assert len(got) == len(sources) * (len(sources) + 1) // 2
    for a, b in [(sources[0], sources[0]), (sources[1], sources[2]), (sources[-2], sources[-1])]:
        rest = models.fit(rows.filter(~F.col("source_id").isin(a, b)), F.col("temporal"), []).first()
        for part in ("q1", "median", "q3", "scale", "zero_iqr", "fitted_rows"):
            assert got[a, b][part] == rest[part]


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize("width", ["low", "both"])
def test_text_keys_of_which_some_are_resolved_before_others(spark, small_tables, monkeypatch, broadcast, width):
    monkeypatch.setattr(order_stats, "BROADCAST_ROWS", broadcast)
    rows = [("low", f"g{i % 3}", 0.25 * (i % 4)) for i in range(40)] + [("high", f"g{i % 3}", float(i * i if width == "both" else i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g string, v double").unionByName(spark.createDataFrame([(None, "g0", 1.0 * i) for i in range(9)], "k string, g string, v double"))
    got = {(r["k"], r["out_a"]): (r["n"], r["largest"], r["median"], r["mad"]) for r in order_stats.spread(df, "v", ["k"], group="g", leave_out=1).collect()}
    want = {}
    for k in ("low", "high", None):
        own = [(r["g"], r["v"]) for r in df.filter(F.col("k").eqNullSafe(F.lit(k))).collect()]
        for g in ("g0", "g1", "g2"):
            v = np.array([x for h, x in own if h != g])
            want[k, g] = (len(v), v.max(), np.median(v), np.median(np.abs(v - np.median(v)))) if len(v) else (0, None, None, 0.0)
    assert got == want


@pytest.mark.parametrize("name", ["attribution_counts", "fold_threshold_table", "loso_predictions", "loso_thresholds", "loso_video_predictions", "main_attribution", "max_with_fold_threshold", "pooled_decisions", "pooled_thresholds", "stream_scores_with_thresholds"])
def test_threshold_queries_equal_themselves_when_ranges_are_refined(spark, monkeypatch, name):
    want = sorted(catalog.QUERIES[name](spark, DATA).collect(), key=str)
    monkeypatch.setattr(order_stats, "GATHER", 5)
    assert sorted(catalog.QUERIES[name](spark, DATA).collect(), key=str) == want
