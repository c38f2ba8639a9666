"""Bundles: whole lists only, cells of any text, and every changed, missing or added file named."""

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import order_stats
from mosaiq.plans import catalog
from mosaiq.sources import bundles

NAMES = ("a", "b", "none")


@pytest.fixture
def folder(spark, tmp_path):
    a = spark.createDataFrame([(1, 'say "no",\nthen \\ go', [1, 2], None), (2, "plain", [], "x")], "k int, t string, v array<int>, n string")
    bundles.save({"a": a, "b": spark.range(50).repartition(3).withColumn("s", F.lit(0.5)), "none": spark.range(0)}, str(tmp_path / "out"), NAMES)
    return tmp_path / "out"


def test_tables_are_whole(spark, folder):
    got = {r["k"]: r for r in bundles.load(spark, str(folder), "a").collect()}
    assert (got["1"]["t"], got["1"]["v"], got["1"]["n"]) == ('say "no",\nthen \\ go', "[1,2]", None) and got["2"]["n"] == "x"
    rows = {r["table"]: r for r in bundles.summary(spark, str(folder)).collect()}
    assert {n: (r["rows"], r["rows_read"], r["columns"], r["files_wrong"]) for n, r in rows.items()} == {"a": (2, 2, "k,t,v,n", 0), "b": (50, 50, "id,s", 0), "none": (0, 0, "id", 0)}
    assert bundles.verify(spark, str(folder)).count() == 0


def test_each_difference_is_named(spark, folder):
    part = next((folder / "a").glob("part-*.csv"))
    gone, other = sorted((folder / "b").glob("part-*.csv"))[:2]
    text = part.read_bytes()
    part.write_bytes(text.replace(b"plain", b"plane"))
    (folder / "a" / f".{part.name}.crc").unlink(missing_ok=True)
    gone.unlink()
    (folder / "b" / "part-new.csv").write_bytes(other.read_bytes())
    got = {(r["table"], r["file"], r["reason"]) for r in bundles.verify(spark, str(folder)).collect()}
    assert got == {("a", part.name, "changed"), ("b", gone.name, "missing"), ("b", "part-new.csv", "not in the manifest")}


def test_other_lists_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match=r"missing: \['b', 'none'\], not of the bundle: \['c'\]"):
        bundles.save({"a": spark.range(1), "c": spark.range(1)}, str(tmp_path / "out"), NAMES)
    assert not (tmp_path / "out").exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bundles.verify(spark, str(tmp_path))


def test_threshold_tables_of_which_ranges_are_refined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order_stats, "GATHER", 5)
    names = ("pooled_thresholds", "loso_thresholds")
    bundles.save({n: catalog.QUERIES[n](spark, "/root/testdata/sf0.01") for n in names}, str(tmp_path / "out"), names)
    assert {r["table"]: (r["rows"], r["rows_read"], r["files_wrong"]) for r in bundles.summary(spark, str(tmp_path / "out")).collect()} == {"pooled_thresholds": (3, 3, 0), "loso_thresholds": (30, 30, 0)}
