"""Pixel features from decoded gray frames: Arrow batches of stacked images in NumPy.

Frames are rows with height, width and pixels (8-bit BINARY, or an array of numbers). `frame_sharpness`, `frame_pairs` and
`frame_hashes` give rows that the segment vectors and the frame-hash comparison take; `embed` takes any function from images
to vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from mosaiq.operators.segments import PAIR_FEATURES, SHARPNESS_FEATURES

SIZE = 224


def image(pixels, height: int, width: int) -> np.ndarray:
    """Values in [0, 1]: bytes and other values in an 8-bit range are scaled."""
    given = np.asarray(pixels)
    x = given.astype(np.float64).reshape(height, width)
    if not x.size or not np.isfinite(x).all():
        raise ValueError("the image is empty or not finite")
    return np.clip(x / 255 if given.dtype == np.uint8 or x.max() > 1.5 else x, 0, 1)


def area_resize(x: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Area averaging, by interpolated cumulative sums."""
    for axis in (0, 1):
        n = x.shape[axis]
        sums = np.insert(np.cumsum(x, axis, dtype=np.float64), 0, 0, axis)
        edges = np.linspace(0, n, size + 1)
        low = np.minimum(edges.astype(int), n - 1)
        part = np.expand_dims(edges - low, tuple(i for i in range(2) if i != axis))
        at = np.take(sums, low, axis) + part * np.take(x, low, axis)
        x = np.diff(at, axis=axis) / (n / size)
    return x


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with reflected borders."""
    k = kernel.shape[0] // 2
    p = np.pad(x, k, "reflect") if min(x.shape) > k else np.pad(x, k, "edge")
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(p, kernel.shape), kernel)


def gaussian(x: np.ndarray, k: int = 3) -> np.ndarray:
    """0 leaves the image as it is; even sizes are errors."""
    if k == 0:
        return x
    if k % 2 == 0:
        raise ValueError("the kernel size is odd")
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma**2))
    w /= w.sum()
    return convolve(x, np.outer(w, w))


def shifted(x: np.ndarray, border: str = "reflect") -> Callable[[int, int], np.ndarray]:
    """Neighbours of every pixel of stacked images: at(dy, dx). Borders reflect, or repeat the edge where `edge` is given."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), border if min(x.shape[1:]) > 1 else "edge")
    h, w = x.shape[1:]
    return lambda dy, dx: p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def sobel(x: np.ndarray, border: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    """Derivatives along the columns and the rows of stacked images, by 3 x 3 kernels."""
    at = shifted(x, border)
    return (at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1)), (at(1, -1) - at(-1, -1)) + 2 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))


def edges(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels of stacked 8-bit images: thin ridges of the gradient above `low` that touch, through others, one above `high`.

    The gradient's size is |dx| + |dy|. A pixel is on a ridge if it is larger than its neighbour before and not smaller than
    the one behind it (larger than both on diagonals), along its direction in steps of 45 degrees. Connection is by eight
    neighbours; only the pixels that were reached last are looked at again.
    """
    x = x.astype(np.int64)
    dx, dy = sobel(x, "edge")
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    h, w = size.shape[1:]
    at = lambda i, j: p[:, 1 + i : 1 + i + h, 1 + j : 1 + j + w]
    # fixed values: the tangent of 22.5 degrees in units of 2 ** -15; that of 67.5 degrees is larger by 2
    steep, flat = np.abs(dy) << 15, np.abs(dx) * 13573
    across, upright = steep < flat, steep > flat + (np.abs(dx) << 16)
    rising = (dx ^ dy) < 0
    ridge = np.where(across, (size > at(0, -1)) & (size >= at(0, 1)), np.where(upright, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(rising, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    weak = np.pad(ridge & (size > low), ((0, 0), (1, 1), (1, 1)))
    marked = np.pad(ridge & (size > high), ((0, 0), (1, 1), (1, 1)))
    row = w + 2
    around = np.array([-row - 1, -row, -row + 1, -1, 1, row - 1, row, row + 1])
    weak_, marked_ = weak.reshape(-1), marked.reshape(-1)
    reached = np.flatnonzero(marked_)
    while len(reached):
        near = (reached[:, None] + around).reshape(-1)
        reached = np.unique(near[weak_[near] & ~marked_[near]])
        marked_[reached] = True
    return marked[:, 1:-1, 1:-1]


def pair_features(a: np.ndarray, b: np.ndarray, threshold: float = 20) -> np.ndarray:
    """By pair of stacked images: mean, deviation and root mean square of the change, share above the threshold, its 90th percentile, share of edge change."""
    a, b = (np.atleast_3d(x.T).T if x.ndim == 2 else x for x in (a.astype(np.float64), b.astype(np.float64)))
    d = np.abs(b - a).reshape(len(a), -1)
    edge = np.abs(np.hypot(*sobel(b)) - np.hypot(*sobel(a))).reshape(len(a), -1)
    return np.stack([d.mean(1), d.std(1), np.sqrt((d**2).mean(1)), (d > threshold / 255).mean(1), np.percentile(d, 90, axis=1), (edge > threshold / 255).mean(1)], axis=1)


def dct(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n)[None] + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def box_mean(x: np.ndarray, size: int = 15) -> np.ndarray:
    """Mean over a square around every pixel of stacked images, by summed areas; borders reflect."""
    k = size // 2
    p = np.pad(x, ((0, 0), (k, k), (k, k)), "reflect" if min(x.shape[1:]) > 1 else "edge")
    s = np.pad(p.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return (s[:, size:, size:] - s[:, :-size, size:] - s[:, size:, :-size] + s[:, :-size, :-size]) / size**2


def sharpness(x: np.ndarray, lowest: int = 32) -> np.ndarray:
    """By stacked image in [0, 1]: variance of the Laplacian, mean squared gradient, share of edge pixels, energy outside the lowest frequencies, mean local deviation."""
    x = (x[None] if x.ndim == 2 else x).astype(np.float64)
    at = shifted(x)
    laplacian = 2 * (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) - 8 * x
    gx, gy = sobel(x)
    energy = (dct(x.shape[1]) @ x @ dct(x.shape[2]).T) ** 2
    total = energy.sum((1, 2))
    high = np.where(total > 1e-12, (total - energy[:, :lowest, :lowest].sum((1, 2))) / np.maximum(total, 1e-12), 0)
    local = np.sqrt(np.maximum(box_mean(x**2) - box_mean(x) ** 2, 0))
    return np.stack([laplacian.var((1, 2)), (gx**2 + gy**2).mean((1, 2)), edges((x * 255).astype(np.uint8)).mean((1, 2)), np.clip(high, 0, 1), local.mean((1, 2))], axis=1)


def linear_weights(n: int, size: int) -> np.ndarray:
    """size x n: the weights of linear interpolation between pixel centres."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(0, n - 2))
    out = np.zeros((size, n))
    np.add.at(out, (np.arange(size), low), 1 - (at - low))
    np.add.at(out, (np.arange(size), np.minimum(low + 1, n - 1)), at - low)
    return out


def frame_hash(x: np.ndarray, median: bool = False) -> np.ndarray:
    """64 bits of each stacked image as a signed number, the first bit highest: which of the 8 x 8 lowest frequencies, the
    constant one taken as 0, of the image at 32 x 32 pixels are above their mean (or median)."""
    rows, columns = (dct(32)[:8] @ linear_weights(n, 32) for n in x.shape[1:])
    low = (rows @ x.astype(np.float64) @ columns.T).reshape(len(x), 64)
    low[:, 0] = 0
    bits = low > (np.median(low, axis=1) if median else low.mean(axis=1))[:, None]
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)[:, 0]


def prepared(x: np.ndarray, size: int = SIZE, kernel: int = 0) -> np.ndarray:
    """An image by area averaging at size x size (0: as it is), smoothed (0: not)."""
    return gaussian(area_resize(x, size) if size else x, kernel)


def _stacks(images: list[tuple[np.ndarray | None, ...]]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows of equal image shapes, as places and stacked images."""
    shapes: dict[tuple, list[int]] = {}
    for i, parts in enumerate(images):
        if all(p is not None for p in parts):
            shapes.setdefault(tuple(p.shape for p in parts), []).append(i)
    for places in shapes.values():
        yield places, [np.stack([images[i][k] for i in places]) for k in range(len(images[places[0]]))]


def measured(rows: DataFrame, keys: list[str], columns: list[str], names: list[str], measure: Callable[..., np.ndarray], prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x, kind: str = "double", group: int = 16) -> DataFrame:
    """Keys, one column a measured value and an error, which is null if all went well.

    rows have height, width and the image columns (8-bit BINARY or an array of numbers). Images pass through as Arrow
    batches and are measured in stacks of at most `group` of one shape; a bad image is a row with an error, not a failed job.
    """
    shape = StructType([*(rows.schema[k] for k in keys), *(StructType.fromDDL(f"{n} {kind}")[0] for n in names), *StructType.fromDDL("error string")])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, group):
                batch = whole.slice(start, group)
                images, errors = [], []
                sizes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())
                for i, (h, w) in enumerate(sizes):
                    try:
                        images.append(tuple(prepare(image(_pixels(batch.column(c)[i]), h, w)) for c in columns))
                        errors.append(None)
                    except (ValueError, TypeError) as e:
                        images.append((None,) * len(columns))
                        errors.append(str(e))
                values = [[None] * batch.num_rows for _ in names]
                for places, stacked in _stacks(images):
                    found = measure(*stacked).reshape(len(places), len(names))
                    for i, row in zip(places, found.tolist()):
                        for k, v in enumerate(row):
                            values[k][i] = v
                yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(arrow.field(k).type) for k in keys), *(pa.array(v, arrow.field(n).type) for n, v in zip(names, values)), pa.array(errors, pa.string())], schema=arrow)

    return rows.select(*keys, "height", "width", *columns).mapInArrow(run, shape)


def _pixels(cell: pa.Scalar) -> np.ndarray:
    if not cell.is_valid:
        raise ValueError("no image")
    if pa.types.is_binary(cell.type) or pa.types.is_large_binary(cell.type):
        return np.frombuffer(cell.as_py(), np.uint8)
    return cell.values.to_numpy(zero_copy_only=False)


def frame_sharpness(frames: DataFrame, keys: list[str], size: int = SIZE, lowest: int = 32) -> DataFrame:
    """keys, height, width, pixels -> keys, the five metrics that segments.sharpness_vector takes, and an error."""
    return measured(frames, keys, ["pixels"], list(SHARPNESS_FEATURES), lambda x: sharpness(x, lowest), lambda x: prepared(x, size))


def frame_pairs(frames: DataFrame, keys: list[str], order: str = "frame_index", size: int = SIZE, kernel: int = 3, threshold: float = 20) -> DataFrame:
    """The six change features of adjacent frames of each group `keys`, as segments.temporal_vector takes them: keys, pair_index, features, error.

    Only neighbours are paired: a missing frame number leaves no pair."""
    near = Window.partitionBy(*keys).orderBy(order)
    ahead = [F.lead(c).over(near).alias(f"next_{c}") for c in (order, "pixels", "height", "width")]
    pairs = frames.select(*keys, F.col(order).alias("pair_index"), "height", "width", "pixels", *ahead).filter(F.col(f"next_{order}") == F.col("pair_index") + 1)
    same = (F.col("height") == F.col("next_height")) & (F.col("width") == F.col("next_width"))
    pairs = pairs.withColumn("next_pixels", F.when(same, F.col("next_pixels")))
    return measured(pairs, [*keys, "pair_index"], ["pixels", "next_pixels"], list(PAIR_FEATURES), lambda a, b: pair_features(a, b, threshold), lambda x: prepared(x, size, kernel))


def frame_hashes(frames: DataFrame, keys: list[str], median: bool = False) -> DataFrame:
    """keys, hash64 and success, as compare.hash_pairs takes them, and an error."""
    found = measured(frames, keys, ["pixels"], ["hash64"], lambda x: frame_hash(x, median), kind="long")
    return found.withColumn("success", F.col("error").isNull())


def embed(frames: DataFrame, keys: str, load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]]) -> DataFrame:
    """Embeddings by a model that `load` makes once a worker."""
    names = [c.split()[0] for c in keys.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if len(batch):
                vectors = model([image(r.pixels, r.height, r.width) for r in batch.itertuples(index=False)])
                yield batch[names].assign(embedding=[np.asarray(v, np.float32) for v in vectors])

    return frames.select(*names, "height", "width", "pixels").mapInPandas(run, f"{keys}, embedding array<float>")


def blur_ladder(x: np.ndarray, sizes: tuple[int, ...] = (1, 3, 5, 9, 15)) -> list[np.ndarray]:
    return [gaussian(x, k) if k > 1 else x for k in sizes]
