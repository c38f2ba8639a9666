import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.sources import readers


def test_files_beyond_two_gigabytes_are_hashed_in_pieces(spark, tmp_path):
    """A sparse file that no row could hold; nothing is allocated for it."""
    size = (2 << 30) + 4096
    with open(tmp_path / "large.mp4", "wb") as f:
        f.truncate(size)
    (tmp_path / "small name.mov").write_bytes(b"abc")
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for k in range(0, size, len(zeros)):
        want.update(zeros[: size - k])
    got = {r["filename"]: r for r in readers.files(spark, str(tmp_path), content=True).collect()}
    assert (got["large.mp4"]["size"], got["large.mp4"]["sha256"]) == (size, want.hexdigest())
    assert got["small name.mov"]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert readers.file_digest(f"file:{tmp_path}/small name.mov", size=2) == got["small name.mov"]["sha256"]


def test_unreadable_files_are_rows_and_skipped_files_have_reasons(spark, tmp_path):
    for name in ("a.mp4", "note.txt", "none"):
        (tmp_path / name).write_bytes(b"x")
    listed = readers.files(spark, str(tmp_path))
    gone = listed.withColumn("path", F.concat("path", F.lit(".gone")))
    assert all(r["sha256"] is None and r["error"] for r in readers.hashed(gone).collect())
    videos, skipped = readers.supported(listed.unionByName(listed.filter("filename = 'a.mp4'").withColumn("filename", F.lit(".hidden.mp4"))))
    assert [r["filename"] for r in videos.collect()] == ["a.mp4"]
    assert {r["filename"]: r["reason"] for r in skipped.collect()} == {".hidden.mp4": "hidden", "note.txt": "unsupported extension", "none": "unsupported extension"}


def test_arrays_of_every_kind_pass_whole(spark, tmp_path):
    rng = np.random.default_rng(0)
    arrays = {"wide": rng.normal(size=(500, 40)).astype("f4"), "half": np.array([0.5, np.nan, np.inf], "f2"), "bits": rng.integers(0, 2, (7, 3)).astype("u1"), "ids": np.array([-(2**40), 2**40]), "flags": np.array([True, False]), "one": np.float64(3.5), "none": np.zeros((0, 4)), "text": np.array(["a", "b"]), "turned": np.arange(6.0).reshape(2, 3).T, "big": np.arange(3, dtype=">i4")}
    np.savez_compressed(tmp_path / "a.npz", **arrays)
    (tmp_path / "below").mkdir()
    np.savez(tmp_path / "below" / "b.npz", x=np.arange(3))
    got = {r["name"]: r for r in readers.npz(spark, str(tmp_path)).collect()}
    assert set(got) == {*arrays, "x"} and got["x"]["path"].endswith("below/b.npz")
    for name, v in arrays.items():
        v = np.asarray(v)
        assert (got[name]["dtype"], got[name]["shape"]) == (str(v.dtype), list(v.shape))
        assert got[name]["values"] is None if name == "text" else np.array_equal(got[name]["values"], v.ravel().astype(float), equal_nan=True)


def test_pickled_arrays_are_refused(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="allow_pickle"):
        readers.npz(spark, str(tmp_path)).collect()
