"""Array files as a data source: round trips of every kind, pruning, commit and refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.sources import arrays

RNG = np.random.default_rng(5)
ARRAYS = {
    "segment_ids": np.array([0, 1, 2**60 + 1, -(2**62)]),
    "start_times": np.array([0.0, 5.0, np.nan, np.inf]),
    "bits": RNG.integers(0, 2, (4, 7)).astype("u1"),
    "vectors": RNG.normal(size=(600, 400)).astype("f4"),
    "flags": np.array([True, False]),
    "length": np.asarray(40, dtype="i8"),
    "none": np.zeros((0, 4)),
    "labels": np.array(["a", "bcd"]),
    "turned": np.arange(6.0).reshape(2, 3).T,
    "big": np.arange(3, dtype=">i4"),
    "empty words": np.array(["", ""], dtype="U1"),
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "below").mkdir(parents=True)
    np.savez_compressed(tmp_path / "in" / "a.npz", **ARRAYS)
    np.savez(tmp_path / "in" / "below" / "b.npz", bits=np.arange(3), extra=np.arange(2.0))
    (tmp_path / "in" / "_hidden.npz").write_bytes(b"no archive")
    return tmp_path


def stored(path):
    with np.load(path, allow_pickle=False) as found:
        return {n: found[n] for n in found.files}


def same(a, b):
    return a.dtype == b.dtype and a.shape == b.shape and np.ascontiguousarray(a).tobytes() == np.ascontiguousarray(b).tobytes()


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip_keeps_every_kind_to_the_bit(spark, folder, compressed):
    arrays.write(arrays.read(spark, str(folder / "in"), exact=True).repartition(7), str(folder / "out"), compressed=compressed)
    assert sorted(str(p.relative_to(folder / "out")) for p in (folder / "out").rglob("*") if p.is_file()) == ["a.npz", "below/b.npz"]
    got = stored(folder / "out" / "a.npz")
    assert set(got) == set(ARRAYS) and all(same(got[n], v) for n, v in ARRAYS.items())
    assert same(stored(folder / "out" / "below" / "b.npz")["bits"], np.arange(3))


def test_blocks_cover_arrays_in_order_and_large_files_are_split_by_array(spark, folder):
    whole = arrays.read(spark, str(folder / "in"))
    split = arrays.read(spark, str(folder / "in"), partition_bytes=100)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == len(ARRAYS) + 2
    for df in (whole, split):
        rows = df.filter("name = 'vectors'").orderBy("first").collect()
        assert [r["first"] for r in rows] == list(range(0, 240_000, arrays.ELEMENTS))
        assert np.array_equal(np.concatenate([r["values"] for r in rows]), ARRAYS["vectors"].ravel().astype(float))
    other = {r["name"]: r for r in whole.filter("file = 'a.npz' and name <> 'vectors'").collect()}
    assert other["labels"]["values"] is None and other["none"]["values"] == [] and other["length"]["shape"] == []
    assert other["turned"]["values"] == [0.0, 3.0, 1.0, 4.0, 2.0, 5.0] and other["big"]["dtype"] == ">i4"


def test_filters_and_headers_open_no_other_array(spark, folder):
    np.savez(folder / "in" / "c.npz", objects=np.array([{}], dtype=object), bits=np.arange(2))
    df = arrays.read(spark, str(folder / "in")).filter(F.col("name").isin("bits", "absent"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan  # the source took the filter
    assert "Filter (" in df.filter("first > 5")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["file"] for r in df.collect()) == ["a.npz", "below/b.npz", "c.npz"]
    assert df.filter("file = 'c.npz' and name = 'bits' and first = 0").count() == 1
    assert df.filter("name = 'extra'").count() == 0
    assert arrays.headers(spark, str(folder / "in")).filter("file = 'a.npz'").count() == len(ARRAYS)
    with pytest.raises(Exception, match="are not read"):
        arrays.read(spark, str(folder / "in")).collect()


def test_packed_rows_of_a_table(spark, tmp_path):
    rows = [("x.npz", k, float(k) / 3, [float(k), k + 0.5]) for k in range(50)] + [("y.npz", 0, 1.0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "f string, k int, t double, v array<double>").repartition(5)
    blocks = arrays.pack(df, "f", ["k"], {"ids": ("k", "i8"), "times": ("t", "f8"), "vectors": ("v", "f4")})
    arrays.write(blocks, str(tmp_path / "p"))
    got = stored(tmp_path / "p" / "x.npz")
    assert same(got["ids"], np.arange(50)) and same(got["times"], np.arange(50) / 3)
    assert same(got["vectors"], np.array([r[3] for r in rows[:50]], "f4")) and stored(tmp_path / "p" / "y.npz")["vectors"].shape == (1, 2)
    first = (tmp_path / "p" / "x.npz").read_bytes()
    with pytest.raises(Exception, match="files that exist"):
        arrays.write(blocks, str(tmp_path / "p"))
    assert not list((tmp_path / "p").glob("_temporary*"))
    arrays.write(blocks.filter("file = 'x.npz'").repartition(3), str(tmp_path / "p"), overwrite=True)
    assert [p.name for p in (tmp_path / "p").iterdir()] == ["x.npz"] and (tmp_path / "p" / "x.npz").read_bytes() == first


@pytest.mark.parametrize(
    ("change", "told"),
    [
        ("first + if(first > 0, 1, 0) as first", "does not follow"),
        ("if(first = 2, 'f8', dtype) as dtype", "does not follow"),
        ("transform(shape, x -> x + 1) as shape", "its shape is"),
        ("transform(values, x -> x + 0.5) as values", "can't hold"),
        ("cast(null as string) as file", "no name"),
        ("'../x.npz' as file", "no name"),
        ("cast(null as string) as name", "no name"),
        ("cast(null as array<double>) as values", "without data"),
    ],
)
def test_malformed_blocks_leave_nothing(spark, tmp_path, change, told):
    df = spark.createDataFrame([("x.npz", "a", "<i8", [4], k, [float(k)]) for k in range(4)], arrays.ddl(arrays.BLOCK))
    column = change.rsplit(" as ", 1)[1]
    with pytest.raises(Exception, match=told):
        arrays.write(df.select(*(F.expr(change) if c == column else F.col(c) for c in df.columns)), str(tmp_path / "p"))
    assert not list((tmp_path / "p").rglob("*")) if (tmp_path / "p").exists() else True


def test_repeated_rows_are_errors_and_empty_tables_write_nothing(spark, tmp_path):
    df = spark.createDataFrame([("x.npz", "a", "<i8", [1], 0, [1.0])], arrays.ddl(arrays.BLOCK))
    with pytest.raises(Exception, match="does not follow"):
        arrays.write(df.unionByName(df), str(tmp_path / "p"))
    arrays.write(df.filter("false"), str(tmp_path / "q"))
    assert arrays.read(spark, str(tmp_path / "q")).count() == 0
    arrays.write(df.withColumn("note", F.lit(1)), str(tmp_path / "q"))
    assert arrays.read(spark, str(tmp_path / "q")).first()["values"] == [1.0]
