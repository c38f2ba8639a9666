"""The registry: ids, references, notes and comparisons, with folders that have none or several references."""

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import registry
from mosaiq.sources import readers

FILES = [("My clip!", f) for f in ("Original.mp4", "a_blur.mp4", "B_blur.mp4", "x.avi", "odd.mkv", "blur_480p.mp4", "other.webm")] + [("two", "original.mov"), ("two", "original.avi"), ("two", "x.mov"), ("named", "NAMED.mp4"), ("named", "take.mp4"), (None, "x.avi")]


@pytest.fixture
def built(spark):
    videos = spark.createDataFrame([(*f, k) for k, f in enumerate(FILES)], "folder string, filename string, size int").withColumn("sha256", F.when(F.col("filename") != "x.mov", F.md5("filename")))
    return registry.build(videos, readers.choose_references(videos))


def test_ids_references_and_notes(built):
    got = {(r["folder"], r["filename"]): r for r in built.collect()}
    assert len(got) == len(FILES)
    clip = {f: r for (d, f), r in got.items() if d == "My clip!"}
    start = clip["Original.mp4"]["reference_video_id"].removesuffix("_ORIGINAL")
    assert {r["source_id"] for r in clip.values()} == {"SRC_" + start} and clip["Original.mp4"]["video_id"] == start + "_ORIGINAL"
    assert (clip["a_blur.mp4"]["video_id"], clip["B_blur.mp4"]["video_id"]) == (start + "_BLUR", start + "_BLUR_2")
    assert (clip["blur_480p.mp4"]["video_id"], clip["blur_480p.mp4"]["category"], clip["blur_480p.mp4"]["notes"]) == (start + "_BLUR_480P", "ambiguous", [registry.AMBIGUOUS])
    assert [clip[f]["video_id"] for f in ("odd.mkv", "other.webm")] == [start + "_ODD", start + "_OTHER_2"]
    assert (clip["odd.mkv"]["expected"], clip["odd.mkv"]["confidence"], clip["odd.mkv"]["notes"]) == ("unknown", 0.1, [registry.UNSUPPORTED])
    assert (clip["Original.mp4"]["category"], clip["Original.mp4"]["confidence"], clip["Original.mp4"]["notes"]) == ("reference", 1.0, [])
    two = [r for (d, _), r in got.items() if d == "two"]
    assert {(r["status"], r["reference_video_id"]) for r in two} == {("blocked", None)} and all(r["notes"][0] == registry.NO_REFERENCE for r in two)
    assert got["named", "NAMED.mp4"]["category"] == "reference" and got["named", "take.mp4"]["category"] == "unsupported"
    assert got[None, "x.avi"]["video_id"] == "VIDEO_AVI" and got[None, "x.avi"]["category"] == "benign"


def test_comparisons_with_the_reference(spark, built):
    got = {r["video_id"]: r for r in registry.metadata_comparison(built, ["size"], ["filename"], ["expected"]).collect()}
    assert (got["NAMED_ORIGINAL"]["size_delta"], got["TWO_MOV"]["size_delta"], got["TWO_MOV"]["reference_size"]) == (0, None, None)
    assert got["NAMED_ORIGINAL"]["reference_filename"] == "NAMED.mp4"
    bytes_ = {(r["video_id"], r["matches_original"], r["original_sha256"] != "") for r in registry.byte_baseline(built).collect()}
    assert ("NAMED_ORIGINAL", True, True) in bytes_ and ("TWO_MOV", False, False) in bytes_ and ("VIDEO_AVI", False, False) in bytes_
    assert registry.byte_baseline(built.filter("false")).count() == 0
    double = spark.createDataFrame([("s", "a", "reference", None), ("s", "b", "benign", None)], "source_id string, video_id string, category string, sha256 string")
    assert {r["matches_original"] for r in registry.byte_baseline(double).collect()} == {True}
    with pytest.raises(Exception, match="several references of s"):
        registry.byte_baseline(double.unionByName(double)).collect()
