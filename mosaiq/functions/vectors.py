"""Vectors, bit digests and their distances as array expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON, CLIP = 1e-8, 5.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column, epsilon: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(v), F.lit(epsilon))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: (x / n).cast("float"))), 1)


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def is_binary(bits: Column) -> Column:
    return F.forall(bits, lambda b: b.isin(0, 1))


def robust_scale(v: Column, median: Column, scale: Column, clip: float = CLIP) -> Column:
    """(x - median) / scale, clipped, as FLOAT."""
    centred = F.zip_with(v, median, lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, scale, lambda x, s: F.greatest(F.lit(-clip), F.least(F.lit(clip), x / s)).cast("float"))


def thresholds(q: Column, median: Column, scale: Column) -> Column:
    """Quartiles on the scaled axis, as FLOAT."""
    return F.zip_with(F.zip_with(q, median, lambda a, m: a - m), scale, lambda a, s: (a / s).cast("float"))


def binary_bits(v: Column) -> Column:
    """1 where the scaled value reaches its threshold, which is 0 for a median; equality counts."""
    return F.transform(v, lambda x: (x >= F.lit(0.0).cast("float")).cast("int"))


def quartile_bins(v: Column, low: Column, high: Column) -> Column:
    """0 to 3: how many of the lower quartile, the median (0) and the upper quartile the value reaches; the highest decides."""
    both = F.zip_with(low, high, lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.zip_with(v, both, lambda x, q: F.when(x >= q["high"], 3).when(x >= F.lit(0.0).cast("float"), 2).when(x >= q["low"], 1).otherwise(0))


def gray_bits(bins: Column) -> Column:
    """Two bits a bin; neighbouring bins differ in one."""
    return F.flatten(F.transform(bins, lambda b: F.array(F.shiftright(b, 1), b.bitwiseXOR(F.shiftright(b, 1)).bitwiseAND(F.lit(1)))))


def pack_bits(bits: Column, little: bool = False) -> Column:
    """BINARY; the last byte is filled with zeros."""
    padded = F.concat(bits, F.array_repeat(F.lit(0), F.pmod(-F.size(bits), F.lit(8)).cast("int")))
    last = F.floor((F.size(bits) - 1) / 8).cast("int")

    def byte(i: Column) -> Column:
        part = F.slice(padded, i * 8 + 1, 8)
        return F.aggregate(F.reverse(part) if little else part, F.lit(0), lambda a, b: a * 2 + b)

    text = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")
    return F.unhex(F.when(F.size(bits) > 0, text).otherwise(""))


def pad_bits(bits: Column) -> Column:
    return F.pmod(-F.size(bits), F.lit(8)).cast("int")


def unpack_bits(packed: Column, n: Column, little: bool = False) -> Column:
    """The first n bits of BINARY."""
    digits = F.hex(packed)
    order = range(8) if little else range(7, -1, -1)

    def bits(i: Column) -> Column:
        value = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array(*(F.shiftright(value, k).bitwiseAND(F.lit(1)) for k in order))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(packed) - 1, F.lit(0))), bits))
    return F.when(F.octet_length(packed) == 0, F.array().cast("array<int>")).otherwise(F.slice(every, F.lit(1), n))


def hex_text(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def words(bits: Column) -> Column:
    """BIGINT words of 64 bits for distances; the last may be shorter."""
    last = F.floor((F.size(bits) - 1) / 64).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.aggregate(F.slice(bits, i * 64 + 1, 64), F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint"))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def normalized(raw: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(F.try_divide(raw.cast("double"), length), F.lit(0.0))


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def balanced_score(resnet: Column, temporal: Column, weight_r: float = 0.5, weight_t: float = 0.5) -> Column:
    if min(weight_r, weight_t) < 0 or abs(weight_r + weight_t - 1) > 1e-9:
        raise ValueError("weights are non-negative and sum to 1")
    return weight_r * resnet + weight_t * temporal


def weighted_score(distances: list[Column], weights: list[Column]) -> Column:
    """Weighted mean; the sum of the weights is positive."""
    top, total = F.lit(0.0), F.lit(0.0)
    for d, w in zip(distances, weights):
        top, total = top + w * d, total + w
    return top / F.greatest(total, F.lit(1e-12))


def relative_attribution(resnet: Column, temporal: Column, tolerance: float = 1e-9) -> Column:
    d = resnet - temporal
    return F.when((F.abs(resnet) <= tolerance) & (F.abs(temporal) <= tolerance), "no_difference").when(d > tolerance, "resnet_dominant").when(d < -tolerance, "temporal_dominant").otherwise("approximately_equal")


def dominant_stream(resnet: Column, temporal: Column, spatial: Column, blur: Column, tolerance: float = 1e-9) -> Column:
    """The stream of the largest value (ties by name), unless all are 0 or the first two are equal."""
    named = {"resnet_dominant": resnet, "temporal_dominant": temporal, "spatial_quality_dominant": spatial, "blur_loss_dominant": blur}
    ranked = F.array_sort(F.array(*(F.struct((-v).alias("v"), F.lit(k).alias("name")) for k, v in named.items())))
    return F.when(F.greatest(*(F.abs(v) for v in named.values())) <= tolerance, "no_difference").when(F.abs(ranked[0]["v"] - ranked[1]["v"]) <= tolerance, "approximately_equal").otherwise(ranked[0]["name"])


def blur_loss(reference: Column, query: Column) -> Column:
    """Mean relative loss of the positive parts."""
    part = lambda x: F.greatest(x.cast("double"), F.lit(0.0))
    loss = F.zip_with(reference, query, lambda r, q: F.greatest(part(r) - part(q), F.lit(0.0)) / F.greatest(part(r), F.lit(EPSILON)))
    return F.try_divide(_sum(loss), F.size(reference))
