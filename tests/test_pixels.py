import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import compare, pixels, segments


def shapes():
    """Drawn images: bars, a ring, a ramp, weak and strong strokes that touch, noise, flat and tiny ones."""
    y, x = np.mgrid[:40, :48]
    ring = (abs(np.hypot(y - 20, x - 24) - 11) < 3) * 200
    slant = ((y + x) % 23 < 6) * 90 + ((y - x) % 31 < 5) * 60
    ramp = (x * 5) % 256
    stroke = np.where(abs(y - 12) < 2, np.clip(x * 3, 0, 140), 0) + np.where(abs(x - 44) < 2, 250, 0)
    noise = np.random.default_rng(4).integers(0, 256, (40, 48))
    return [z.astype(np.uint8) for z in (ring, slant, ramp, np.clip(stroke, 0, 255), noise, np.full((40, 48), 7), (x > 20) * 255)]


def edges_by_pixel(img, low=50, high=150):
    """The edge rule pixel by pixel, with a stack for the connection."""
    h, w = img.shape
    at = lambda i, j: int(img[min(max(i, 0), h - 1), min(max(j, 0), w - 1)])
    dx, dy, size = ({} for _ in range(3))
    for i in range(h):
        for j in range(w):
            dx[i, j] = sum(c * (at(i + k, j + 1) - at(i + k, j - 1)) for k, c in ((-1, 1), (0, 2), (1, 1)))
            dy[i, j] = sum(c * (at(i + 1, j + k) - at(i - 1, j + k)) for k, c in ((-1, 1), (0, 2), (1, 1)))
            size[i, j] = abs(dx[i, j]) + abs(dy[i, j])
    kind = {}
    for (i, j), m in size.items():
        a, b = abs(dx[i, j]), abs(dy[i, j]) * 2**15
        near = lambda di, dj: size.get((i + di, j + dj), 0)
        if b < a * 13573:
            top = m > near(0, -1) and m >= near(0, 1)
        elif b > a * 13573 + a * 2**16:
            top = m > near(-1, 0) and m >= near(1, 0)
        else:
            s = -1 if (dx[i, j] < 0) != (dy[i, j] < 0) else 1
            top = m > near(-1, -s) and m > near(1, s)
        if top and m > low:
            kind[i, j] = m > high
    todo = [k for k, strong in kind.items() if strong]
    found = set(todo)
    while todo:
        i, j = todo.pop()
        for n in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if n in kind and n not in found:
                found.add(n)
                todo.append(n)
    out = np.zeros(img.shape, bool)
    for k in found:
        out[k] = True
    return out


def test_edges_equal_the_rule_pixel_by_pixel():
    images = shapes()
    got = pixels.edges(np.stack(images))
    for img, edge in zip(images, got):
        assert (edge == edges_by_pixel(img)).all()
    assert got[0].any() and got[3].any() and not got[5].any()
    tiny = np.array([[[9]], [[0]]], np.uint8)
    assert not pixels.edges(tiny).any()


def test_weak_edges_stay_only_where_they_touch_strong_ones():
    img = np.zeros((30, 60), np.uint8)
    img[10:, :30] = 30  # a weak border that meets a strong one, and further down a weak one alone
    img[10:, 30:] = 200
    alone = np.zeros_like(img)
    alone[10:, :] = 30
    both, weak = pixels.edges(np.stack([img, alone]))
    assert both[9:11, :28].any() and not weak.any()


def test_measures_by_plain_sums():
    img = shapes()[1] / 255.0
    h, w = img.shape
    p = np.pad(img, 7, "reflect")
    at = lambda i, j: p[i + 7, j + 7]
    lap = [2 * (at(i - 1, j - 1) + at(i - 1, j + 1) + at(i + 1, j - 1) + at(i + 1, j + 1)) - 8 * at(i, j) for i in range(h) for j in range(w)]
    local = [p[i : i + 15, j : j + 15].std() for i in range(h) for j in range(w)]
    got = pixels.sharpness(img)[0]
    assert got[0] == pytest.approx(np.var(lap)) and got[4] == pytest.approx(np.mean(local))
    assert got[2] == pixels.edges((img * 255).astype(np.uint8)[None])[0].mean()
    t = pixels.dct(h) @ img @ pixels.dct(w).T
    assert (t**2).sum() == pytest.approx((img**2).sum())  # the transform keeps energy
    assert got[3] == pytest.approx(1 - (t[:32, :32] ** 2).sum() / (img**2).sum())


def test_blur_lowers_sharpness():
    y, x = np.mgrid[:224, :224]
    sharp = ((x * 37 + y * 61) % 251) / 255
    rows = np.concatenate([pixels.sharpness(z) for z in pixels.blur_ladder(sharp)])
    assert rows[-1, 0] < rows[0, 0] and rows[-1, 1] < rows[0, 1] and rows[-1, 3] < rows[0, 3]
    assert ((0 <= rows[:, 2:4]) & (rows[:, 2:4] <= 1)).all()


@pytest.mark.parametrize("median", [False, True])
def test_hash_of_pixels(median):
    y, x = np.mgrid[:80, :96]
    img = ((x * 7 + y * 11) % 256)[None]
    smooth = (128 + 90 * np.sin(x / 9) * np.cos(y / 13) + x / 4)[None]
    one, again = pixels.frame_hash(img, median), pixels.frame_hash(img.copy(), median)
    assert one.dtype == np.int64 and (one == again).all()
    distance = lambda a, b: bin((int(a[0]) ^ int(b[0])) & (1 << 64) - 1).count("1")
    base = pixels.frame_hash(smooth, median)
    small = pixels.area_resize(smooth[0], 64)[None]
    assert distance(base, base) == 0 and distance(base, pixels.frame_hash(small, median)) <= 4
    assert distance(base, pixels.frame_hash(smooth * 0.5, median)) == 0
    assert distance(base, pixels.frame_hash(img, median)) > 12


def test_operators_over_frames(spark):
    images = shapes()[:5]
    rows = [("v", 0, i, 40, 48, bytearray(img.tobytes())) for i, img in enumerate(images)]
    rows += [("v", 0, 6, 40, 48, bytearray(images[0].tobytes())), ("v", 0, 7, 40, 48, None), ("w", 1, 0, 40, 48, bytearray(b"xx")), ("w", 1, 1, 2, 1, bytearray(b"xx"))]
    frames = spark.createDataFrame(rows, "video_id string, segment_id int, frame_index int, height int, width int, pixels binary")
    keys = ["video_id", "segment_id"]
    sharp = {(r["video_id"], r["frame_index"]): r for r in pixels.frame_sharpness(frames, [*keys, "frame_index"], size=0).collect()}
    for i, img in enumerate(images):
        assert [sharp["v", i][c] for c in segments.SHARPNESS_FEATURES] == pytest.approx(list(pixels.sharpness(img / 255.0)[0]))
    assert sharp["v", 7]["error"] and sharp["w", 0]["error"] and sharp["v", 7]["edge_density"] is None
    vector = segments.sharpness_vector(pixels.frame_sharpness(frames, [*keys, "frame_index"], size=0), keys).filter("video_id = 'v'").first().asDict()
    assert len(vector) == 27 and vector["mean_edge_density"] == pytest.approx(np.mean([sharp["v", i]["edge_density"] for i in (0, 1, 2, 3, 4, 6)]))
    pairs = {r["pair_index"]: r for r in pixels.frame_pairs(frames.filter("video_id = 'v'"), keys, size=0, kernel=0).collect()}
    assert set(pairs) == {0, 1, 2, 3, 6}  # nothing across the missing frame 5
    want = pixels.pair_features(images[1] / 255.0, images[2] / 255.0)[0]
    assert [pairs[1][c] for c in segments.PAIR_FEATURES] == pytest.approx(list(want)) and pairs[6]["error"]
    hashes = pixels.frame_hashes(frames, [*keys, "frame_index"]).withColumn("offset_s", F.lit(0.0))
    assert {r["frame_index"] for r in hashes.filter("not success").collect() if r["video_id"] == "v"} == {7}
    same = compare.hash_segments(compare.hash_pairs(hashes, hashes, [*keys, "frame_index"]), ["video_id"])
    assert {(r["video_id"], r["mean"], r["invalid_pairs"]) for r in same.collect()} == {("v", 0.0, 1), ("w", 0.0, 1)}
