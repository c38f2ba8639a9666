import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mosaiq.operators import chain, compare, identity, models
from mosaiq.sources import checked, sinks

SHAPE = "id long, name string, x double, v array<float>"


def rows(n=300):
    r = random.Random(1)
    return [(i, r.choice(["a", "b", None, "é"]), r.choice([0.5, None, r.random()]), [r.random(), 1.0]) for i in range(n)]


def root(df, key=("id",)):
    return tuple(identity.table_identity(df, list(key)).first())


def test_identity_is_of_the_rows_and_not_of_their_layout(spark):
    df = spark.createDataFrame(rows(), SHAPE)
    assert len({root(df.repartition(n).orderBy(F.rand(n))) for n in (1, 3, 7)}) == 1
    assert root(df.select("v", "x", "name", "id")) == root(df)
    assert root(df.limit(0))[0] == 0
    assert root(df.unionByName(df))[1] != root(df)[1]


def test_every_changed_cell_is_found_in_its_leaf(spark):
    base = rows(60)
    stored = sinks.stage_table(identity.tree(spark.createDataFrame(base, SHAPE), ["id"]), "tree")
    named, known = next(i for i, r in enumerate(base) if r[1]), next(i for i, r in enumerate(base) if r[2] is not None)
    for i, column, value in [(0, 1, "z"), (named, 1, None), (30, 2, 0.25), (known, 2, None), (59, 3, [0.0, 1.0])]:
        new = list(base)
        new[i] = tuple(value if k == column else c for k, c in enumerate(base[i]))
        df = spark.createDataFrame(new, SHAPE)
        found = identity.differing(stored, identity.tree(df, ["id"]))
        assert i in {r["id"] for r in identity.rows_of(df, found, ["id"]).collect()} and found.count() == 1
    fewer, more = spark.createDataFrame(base[1:], SHAPE), spark.createDataFrame([*base, (99, "n", 0.0, [])], SHAPE)
    assert sum(r["rows_stored"] - r["rows_found"] for r in identity.differing(stored, identity.tree(fewer, ["id"])).collect()) == 1
    assert sum(r["rows_found"] - r["rows_stored"] for r in identity.differing(stored, identity.tree(more, ["id"])).collect()) == 1


def test_cancelling_changes_do_not_pass(spark):
    """Two rows that swap a value: counts and sums stay, the digest does not."""
    a, b = spark.createDataFrame([(1, "p"), (2, "q")], "id long, s string"), spark.createDataFrame([(1, "q"), (2, "p")], "id long, s string")
    assert sinks.checksum(a).first() != sinks.checksum(b).first()


def vectors(spark, change=None):
    got = [("v", i, [0.5, -5.0, float(i) / 10]) for i in range(9)]
    return spark.createDataFrame(change(got) if change else got, "video_id string, segment_id int, x array<double>")


def test_normalized_vectors_are_verified_when_read(spark, tmp_path):
    good = f"{tmp_path}/good"
    checked.write_normalized(vectors(spark), good, "v", "cal1", ["video_id"])
    assert checked.read_normalized(spark, good, "v", 3, "cal1").count() == 9
    with pytest.raises(checked.IntegrityError, match="calibration"):
        checked.read_normalized(spark, good, "v", 3, "cal2")
    with pytest.raises(checked.IntegrityError, match="identifier"):
        checked.read_normalized(spark, good, "w", 3)
    with pytest.raises(checked.IntegrityError, match="size"):
        checked.read_normalized(spark, good, "v", 4)
    for name, change, told in [
        ("nan", lambda r: [*r[:-1], ("v", 8, [0.5, float("nan"), 0.0])], "not finite"),
        ("range", lambda r: [*r[:-1], ("v", 8, [0.5, 5.1, 0.0])], "clip range"),
        ("twice", lambda r: [*r, ("v", 3, [0.0, 0.0, 0.0])], "repeated place"),
    ]:
        checked.write_normalized(vectors(spark, change), f"{tmp_path}/{name}", "v", "cal1", ["video_id"])
        with pytest.raises(checked.IntegrityError, match=told):
            checked.read_normalized(spark, f"{tmp_path}/{name}", "v", 3)
    vectors(spark, lambda r: [*r[:4], ("v", 4, [0.5, -5.0, 0.41]), *r[5:]]).write.mode("overwrite").parquet(f"{good}/data")
    with pytest.raises(checked.IntegrityError, match="rows changed in"):
        checked.read_normalized(spark, good, "v", 3, "cal1")


def test_quantizer_is_verified_when_read(spark, tmp_path):
    model = models.fit(spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([4.0, 9.0],)], "v array<double>"), F.col("v"), [])
    checked.write_quantizer(model, f"{tmp_path}/q", "q1", "n1", "d" * 64)
    assert checked.read_quantizer(spark, f"{tmp_path}/q", "q1", "n1").first()["median"] == [3.0, 5.0]
    with pytest.raises(checked.IntegrityError, match="normalization"):
        checked.read_quantizer(spark, f"{tmp_path}/q", "q1", "n2")
    checked.write_quantizer(model.withColumn("scale", F.transform("scale", lambda x: -x)), f"{tmp_path}/bad", "q1", "n1", "d")
    with pytest.raises(checked.IntegrityError, match="scale"):
        checked.read_quantizer(spark, f"{tmp_path}/bad", "q1")
    with pytest.raises(Exception, match="(?i)exists"):
        checked.write_quantizer(model, f"{tmp_path}/q", "q1", "n1", "d")


def segments(spark, ids):
    return spark.createDataFrame([("s", i, i * 5_000_000, (i + 1) * 5_000_000) for i in ids], "source_id string, segment_id int, start_us long, end_us long")


@pytest.mark.parametrize("ref, query, side", [([0, 0], [0], "reference"), ([0], [0, 0], "query"), ([0, 1], [0, 2, 2], "query")])
def test_repeated_segments_are_an_error_and_not_a_fan_out(spark, ref, query, side):
    with pytest.raises(PySparkException, match=f"{side} has duplicate segment ids"):
        compare.align(segments(spark, ref), segments(spark, query), ["source_id", "segment_id"]).collect()
    bits = F.array(F.lit(1), F.lit(0))
    both = [segments(spark, ids).withColumn("resnet_bits", bits).withColumn("temporal_bits", bits) for ids in (ref, query)]
    with pytest.raises(PySparkException, match=f"{side} has duplicate segment ids"):
        chain.compare(both[0], both[1].withColumn("video_id", F.lit("q")), ["source_id"], "video_id", {"resnet": 2, "temporal": 2}).collect()


def test_alignment_of_unique_segments_stands(spark):
    got = {r["segment_id"]: r["state"] for r in compare.align(segments(spark, [0, 1]), segments(spark, [1, 2]), ["source_id", "segment_id"]).collect()}
    assert got == {0: "missing_in_query", 1: "matched", 2: "extra_in_query"}
    with pytest.raises(ValueError, match="tolerance"):
        compare.align(segments(spark, [0]), segments(spark, [0]), ["source_id", "segment_id"], -1)


def test_streams_must_cover_the_same_segments(spark):
    a, b = segments(spark, [0, 1]).select("segment_id", F.lit(1).alias("p")), segments(spark, [0, 1]).select("segment_id", F.lit(2).alias("q"))
    assert compare.complete_join({"a": a, "b": b}, ["segment_id"]).count() == 2
    with pytest.raises(PySparkException, match="b lacks segments"):
        compare.complete_join({"a": a, "b": b.filter("segment_id = 0")}, ["segment_id"]).collect()
    with pytest.raises(PySparkException, match="a has duplicate"):
        compare.complete_join({"a": a.union(a), "b": b}, ["segment_id"]).collect()
