import pytest

from mosaiq.operators import evaluation as E

SHAPE = "k string, expected string, observed string"
ROWS = [("a", "normal", "normal"), ("a", "abnormal", "failed"), ("a", "abnormal", None), ("b", "abnormal", "abnormal"), ("b", "odd", "normal"), (None, "normal", "abnormal")]


def test_failed_rows_are_counted_and_in_no_denominator(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    got = {r["k"]: r for r in E.metrics(E.counts_with_failed(df, ["k"]), zero=True).collect()}
    assert (got["a"]["evaluated"], got["a"]["failed"], got["a"]["accuracy"], got["a"]["recall"]) == (1, 2, 1.0, 0.0)
    assert (got["b"]["evaluated"], got["b"]["failed"], got["b"]["tp"]) == (1, 0, 1)
    assert got[None]["fp"] == 1


def test_listed_labels_keep_zero_rows(spark):
    got = {r["k"]: (r["evaluated"], r["failed"]) for r in E.counts_by_label(spark.createDataFrame(ROWS, SHAPE), "k", ["a", "c", "c"]).collect()}
    assert got == {"a": (1, 2), "c": (0, 0)}


@pytest.mark.parametrize("row", [("x", "odd", "normal"), ("x", "normal", "failed"), ("x", None, "normal")])
def test_unknown_labels_are_rejected(spark, row):
    good = [("x", "normal", "abnormal")]
    assert E.counts(spark.createDataFrame(good, SHAPE), [], strict=True).first()["fp"] == 1
    with pytest.raises(Exception, match="unknown label in"):
        E.counts(spark.createDataFrame([*good, row], SHAPE), [], strict=True).collect()
