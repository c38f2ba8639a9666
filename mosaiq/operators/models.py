"""Robust scalers fitted by training set, and the bit digests built with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import order_stats

STREAMS = ("resnet", "temporal", "spatial")


def all_streams(rows: DataFrame) -> Column:
    return F.concat(*STREAMS)


def fit(rows: DataFrame, vector: Column, by: list[str], epsilon: float = V.EPSILON) -> DataFrame:
    """One row for each training set: quartiles, median, range and safe scale of every dimension, as arrays.

    Exact quantiles by dimension, from counts of ranges; NaN and infinite values are an error.
    """
    cells = rows.select(*by, F.posexplode(vector).alias("pos", "v"))
    return _packed(order_stats.quantiles(cells, "v", [*by, "pos"], [0.25, 0.5, 0.75]), by, epsilon)


def fit_without(rows: DataFrame, vector: Column, group: str, groups: list, leave_out: int, epsilon: float = V.EPSILON) -> DataFrame:
    """As fit, for every set of all groups but one (leave_out 1), or but one and but two (2): out_a, out_b name what is left out."""
    cells = rows.select(group, F.posexplode(vector).alias("pos", "v"))
    return _packed(order_stats.quantiles(cells, "v", ["pos"], [0.25, 0.5, 0.75], group=group, groups=groups, leave_out=leave_out), ["out_a", "out_b"], epsilon)


def _packed(q: DataFrame, by: list[str], epsilon: float) -> DataFrame:
    packed = q.filter("n > 0").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "q", "n"))).alias("s"))
    iqr = F.transform("s", lambda x: x["q"][2] - x["q"][0])
    return packed.select(
        *by,
        F.transform("s", lambda x: x["q"][0]).alias("q1"),
        F.transform("s", lambda x: x["q"][1]).alias("median"),
        F.transform("s", lambda x: x["q"][2]).alias("q3"),
        F.transform(iqr, lambda x: x <= epsilon).alias("zero_iqr"),
        F.transform(iqr, lambda x: F.greatest(x, F.lit(epsilon))).alias("scale"),
        F.element_at("s", 1)["n"].alias("fitted_rows"),
    )


def scaled(rows: DataFrame) -> DataFrame:
    """rows joined with their model get x, the scaled streams in one array, and the quartiles on the scaled axis."""
    x = V.robust_scale(all_streams(rows), F.col("median"), F.col("scale"))
    return rows.select("*", x.alias("x"), V.thresholds(F.col("q1"), F.col("median"), F.col("scale")).alias("low"), V.thresholds(F.col("q3"), F.col("median"), F.col("scale")).alias("high"))


def digests(rows: DataFrame, resnet: int, temporal: int, spatial: int) -> DataFrame:
    """Bits of the three streams from scaled rows: one a dimension for the first, two Gray-coded for the others."""

    def gray(start: int, size: int) -> Column:
        return V.gray_bits(V.quartile_bins(F.slice("x", start, size), F.slice("low", start, size), F.slice("high", start, size)))

    out = rows.withColumn("resnet_bits", V.binary_bits(F.slice("x", 1, resnet))).withColumn("temporal_bits", gray(resnet + 1, temporal)).withColumn("spatial_bits", gray(resnet + temporal + 1, spatial))
    return out.drop("x", "low", "high", "q1", "median", "q3", "scale", "zero_iqr", "fitted_rows")


def clipping(rows: DataFrame, by: list[str], clip: float = V.CLIP, tolerance: float = 1e-6) -> DataFrame:
    """Values at or next to the clip bounds, in all and in percent."""
    low = F.size(F.filter("x", lambda v: v <= F.lit(-clip + tolerance).cast("float")))
    high = F.size(F.filter("x", lambda v: v >= F.lit(clip - tolerance).cast("float")))
    sums = rows.groupBy(*by).agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum(F.size("x")).alias("n"))
    return sums.withColumn("percent", 100 * (F.col("low") + F.col("high")) / F.col("n"))


def bit_statistics(rows: DataFrame, bits: str, by: list[str]) -> DataFrame:
    ones = F.aggregate(F.col(bits), F.lit(0), lambda a, b: a + b)
    sums = rows.groupBy(*by).agg(F.sum(ones).alias("ones"), F.sum(F.size(bits) - ones).alias("zeros"))
    return sums.withColumn("one_ratio", F.try_divide(F.col("ones").cast("double"), F.col("ones") + F.col("zeros")))


def with_model(rows: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """Every row with every model (by empty: a model a training set), or with its own model. The models are a few rows of arrays."""
    return rows.crossJoin(models) if not by else rows.join(models, by)


def digest_summary(coded: DataFrame, by: list[str], streams: tuple[str, ...] = STREAMS) -> DataFrame:
    """Ones, zeros and share of ones of each stream's bits and of all together, in long form: one pass over the digests."""
    bits = {**{s: F.col(f"{s}_bits") for s in streams}, "hybrid": F.concat(*(f"{s}_bits" for s in streams))}
    parts = F.array(*(F.struct(F.lit(n).alias("stream"), F.aggregate(c, F.lit(0), lambda a, b: a + b).alias("ones"), F.size(c).alias("n")) for n, c in bits.items()))
    rows = coded.select(*by, F.explode(parts).alias("p")).select(*by, "p.*")
    out = rows.groupBy(*by, "stream").agg(F.sum("ones").alias("ones"), (F.sum("n") - F.sum("ones")).alias("zeros"))
    return out.withColumn("one_ratio", F.try_divide(F.col("ones").cast("double"), F.col("ones") + F.col("zeros")))
