import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.functions import scalars as S
from mosaiq.functions import vectors as V


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_ids_and_parsing(spark):
    rows = [("Camera 1 / Front Door!.mp4",), ("...",), ("a__b",), ("-x.",)]
    got = [r[0] for r in one(spark, rows, "s string", S.safe_id(S.file_stem(F.col("s"))))]
    assert got == ["Front_Door", "video", "a__b", "x"]
    rates = [("30/1", 30.0), ("30000/1001", 30000 / 1001), ("25", 25.0), ("invalid", None), (None, None), ("0/0", None), ("-5/1", None), ("1/2/3", None)]
    got = [r[0] for r in one(spark, [(a,) for a, _ in rates], "s string", S.frame_rate(F.col("s")))]
    assert got == [b for _, b in rates]
    got = [tuple(r) for r in one(spark, [("N/A",), ("",), ("12.9",), ("-3.5",), ("inf",), ("x",)], "s string", S.optional_int(F.col("s")), S.optional_float(F.col("s")))]
    assert got == [(None, None), (None, None), (12, 12.9), (-3, -3.5), (None, None), (None, None)]


def test_half_even_microseconds(spark):
    values = [0.5e-6, 1.5e-6, 2.5e-6, 0.0000035, 1.1, 17.8, 123.4567895]
    got = [r[0] for r in one(spark, [(v,) for v in values], "v double", S.microseconds(F.col("v")))]
    assert got == [int(round(v * 1e6)) for v in values]


def test_classifiers(spark):
    names = {
        "del.mp4": ("frame_deletion", "unclassified"),
        "fdel.mp4": ("frame_deletion", "unclassified"),
        "a_del.mp4": ("frame_deletion", "unclassified"),
        "blur_480.mp4": ("ambiguous", "blur"),
        "original.mp4": ("unsupported_video", "trusted_reference"),
        "x.AVI": ("avi_conversion", "avi_conversion"),
        "model.mp4": ("unsupported_video", "unclassified"),
        "swap.mp4": ("frame_replacement", "unclassified"),
        "clip_720p.mp4": ("resize_720p", "resize_720p"),
    }
    rows = spark.createDataFrame([(n,) for n in names], "f string").select("f", S.classify_exact_one(F.col("f")), S.classify_first_match(F.col("f"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == names


def test_profile(spark):
    rows = [(".mp4", 854, 480), (".MOV", 1280, 720), ("", 1920, 1080), (".avi", None, 5), (".avi", 0, 5)]
    got = [r[0] for r in one(spark, rows, "e string, w int, h int", S.compression_profile(F.col("e"), F.col("w"), F.col("h")))]
    assert got == [".mp4:480p", ".mov:720p", "unknown:source_res", ".avi:unknown_res", ".avi:unknown_res"]


def test_bins_gray_and_packing(spark):
    x = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
    r = one(spark, [(x, [-1.0] * 7, [1.0] * 7)], "x array<float>, l array<float>, h array<float>", V.quartile_bins(F.col("x"), F.col("l"), F.col("h")).alias("b"), V.binary_bits(F.col("x")).alias("s"))[0]
    assert r["b"] == [0, 1, 1, 2, 2, 3, 3] and r["s"] == [0, 0, 0, 1, 1, 1, 1]
    r = one(spark, [([0, 1, 2, 3],)], "b array<int>", V.gray_bits(F.col("b")).alias("g"))[0]
    assert r["g"] == [0, 0, 0, 1, 1, 1, 1, 0]
    g = np.random.default_rng(0)
    for n in (0, 1, 8, 9, 36, 50, 1024, 1060, 1110):
        bits = g.integers(0, 2, n).tolist()
        df = spark.createDataFrame([(bits,)], "b array<int>")
        for little in (False, True):
            p = V.pack_bits(F.col("b"), little)
            r = df.select(p.alias("p"), V.pad_bits(F.col("b")).alias("pad"), V.unpack_bits(p, F.size("b"), little).alias("u"), V.hex_text(p).alias("h")).first()
            want = np.packbits(np.array(bits, np.uint8), bitorder="little" if little else "big").tobytes()
            assert bytes(r["p"]) == want and r["h"] == want.hex() and r["u"] == bits and r["pad"] == -n % 8


def test_scaling_and_zero_range(spark):
    from mosaiq.operators import models

    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],), ([1.0, 2.0],)], "v array<float>")
    m = models.fit(df, F.col("v"), [])
    q = spark.createDataFrame([([1.0, 100.0],)], "v array<float>").crossJoin(m)
    assert q.select(V.robust_scale(F.col("v"), F.col("median"), F.col("scale")).alias("x")).first()["x"] == [0.0, 5.0]
    assert m.first()["zero_iqr"] == [True, False]
    df = spark.createDataFrame([([float(i), 10.0 * i],) for i in range(1, 5)], "v array<float>")
    r = models.fit(df, F.col("v"), []).first()
    assert (r["q1"], r["median"], r["q3"]) == ([1.75, 17.5], [2.5, 25.0], [3.25, 32.5])


def test_norms_distances_and_checks(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r["n"] for r in df.select(V.l2_norm(F.col("v")).alias("n")).collect()] == [5.0, 0.0]
    assert df.select(V.l2_normalize(F.col("v")).alias("n")).collect()[1]["n"] == [0.0, 0.0]
    g = np.random.default_rng(1)
    a, b = g.integers(0, 2, 1060).tolist(), g.integers(0, 2, 1060).tolist()
    r = one(spark, [(a, b)], "a array<int>, b array<int>", V.hamming(V.words(F.col("a")), V.words(F.col("b"))).alias("w"), V.hamming_bits(F.col("a"), F.col("b")).alias("d"), V.normalized(F.lit(0), 0).alias("z"))[0]
    assert r["w"] == r["d"] == sum(x != y for x, y in zip(a, b)) and r["z"] == 0.0
    r = one(spark, [([1.0, float("nan")], [0, 2])], "v array<float>, b array<int>", V.is_finite(F.col("v")).alias("f"), V.is_binary(F.col("b")).alias("b"))[0]
    assert not r["f"] and not r["b"]
    with pytest.raises(ValueError):
        V.balanced_score(F.lit(0.1), F.lit(0.1), 0.5, 0.6)


def test_attribution_ties(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (0.2, 0.2, 0.1, 0.0), (0.1, 0.3, 0.2, 0.0), (0.0, 0.0, 0.0, 0.5)]
    got = [(r[0], r[1]) for r in one(spark, rows, "r double, t double, s double, b double", V.relative_attribution(F.col("r"), F.col("t")), V.dominant_stream(*(F.col(c) for c in "rtsb")))]
    assert got == [("no_difference", "no_difference"), ("approximately_equal", "approximately_equal"), ("temporal_dominant", "temporal_dominant"), ("no_difference", "blur_loss_dominant")]


def test_canonical_json_and_keys(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, None)], "b string, a int, c int")
    r = df.select(auth.canonical_json({"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}).alias("j")).first()
    assert r["j"] == '{"a":1,"b":"é","c":null}'
    path = str(tmp_path / "key")
    auth.write_key(path)
    with pytest.raises(FileExistsError):
        auth.write_key(path)
    key = auth.load_key(path)
    assert len(key) == 32 and len(auth.key_fingerprint(key)) == 16
    for bad in ("00" * 31, "0" * 65, "zz" * 32):
        with pytest.raises(ValueError):
            auth.parse_key(bad)
    signed = df.select(F.col("b"), auth.sign(F.col("b"), path).alias("tag"))
    assert signed.first()["tag"] == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    assert key.hex() not in signed._jdf.queryExecution().toString()
    got = signed.select(auth.verify(F.col("b"), F.col("tag"), path), auth.verify(F.col("b"), F.lit("xx"), path), auth.verify(F.lit("e"), F.col("tag"), path)).first()
    assert tuple(got) == (True, False, False)


def test_metric_format(spark):
    r = one(spark, [(0.98148,), (None,), (math.nan,)], "v double", S.format_metric(F.col("v")))
    assert [x[0] for x in r] == ["0.9815", "n/a", "n/a"]


def test_no_key_by_default_and_nested_canonical_json(spark):
    with pytest.raises(ValueError):
        auth.load_key()
    assert auth.load_key(auth.DEMONSTRATION) == auth.demonstration_key()
    texts = ['{"b": {"d": 1, "c": [2, {"z": 0, "a": "é"}]}, "a": null}', '{"x": NaN}', '{"x": 1e999}', "{", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(auth.canonical(F.col("t"))).collect()]
    assert got == ['{"a":null,"b":{"c":[2,{"a":"é","z":0}],"d":1}}', None, None, None, None]
