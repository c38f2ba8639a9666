"""Alignment of segments and streams, digest distances, and frame-hash comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import vectors as V


def unique(rows: DataFrame, keys: list[str], label: str, column: str) -> DataFrame:
    """rows, of which `column` is an error as soon as a key is repeated. The count is taken in the shuffle by keys that a join of these rows needs anyway."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.concat(F.lit(f"{label} has duplicate segment ids: "), F.to_json(F.struct(*keys)))
    return rows.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 1, F.raise_error(told).cast(rows.schema[column].dataType)).otherwise(F.col(column))).drop("_n")


def align(reference: DataFrame, query: DataFrame, keys: list[str], tolerance_us: int = 1000) -> DataFrame:
    """Full outer alignment by key: matched, timestamp_mismatch, missing_in_query or extra_in_query. A repeated key on either side is an error."""
    if tolerance_us < 0:
        raise ValueError("the tolerance is not negative")
    r = unique(reference.select(*keys, F.col("start_us").alias("ref_start"), F.col("end_us").alias("ref_end"), F.lit(True).alias("in_ref")), keys, "reference", "in_ref")
    q = unique(query.select(*keys, F.col("start_us").alias("query_start"), F.col("end_us").alias("query_end"), F.lit(True).alias("in_query")), keys, "query", "in_query")
    near = (F.abs(F.col("ref_start") - F.col("query_start")) <= tolerance_us) & (F.abs(F.col("ref_end") - F.col("query_end")) <= tolerance_us)
    state = F.when(F.col("in_query").isNull(), "missing_in_query").when(F.col("in_ref").isNull(), "extra_in_query").when(near, "matched").otherwise("timestamp_mismatch")
    return r.join(q, keys, "full").select(*keys, "ref_start", "query_start", state.alias("state"))


def complete_join(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The sides joined by key. A key that a side lacks or repeats is an error that names side and key: streams must cover the same segments."""
    out = None
    for label, df in sides.items():
        marked = unique(df.withColumn(f"_in_{label}", F.lit(True)), keys, label, f"_in_{label}")
        out = marked if out is None else out.join(marked, keys, "full")
    lacking = F.lit(True)
    for label in sides:
        told = F.concat(F.lit(f"{label} lacks segments: "), F.to_json(F.struct(*keys)))
        lacking = lacking & F.when(F.col(f"_in_{label}").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    return out.filter(lacking).drop(*(f"_in_{label}" for label in sides))


def alignment_summary(aligned: DataFrame, by: list[str]) -> DataFrame:
    """State counts; strict comparison needs every segment matched, partial comparison one."""
    states = ("matched", "missing_in_query", "extra_in_query", "timestamp_mismatch")
    out = aligned.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    valid = (F.col("missing_in_query") == 0) & (F.col("extra_in_query") == 0) & (F.col("timestamp_mismatch") == 0)
    return out.withColumn("alignment_valid", valid).withColumn("comparison_possible", F.col("matched") > 0)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; valid input has none."""
    return rows.groupBy(*keys).count().filter("count > 1")


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; strict stream alignment needs none."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def structural_issues(segments: DataFrame, by: list[str], video: str = "video_id") -> DataFrame:
    """Segments that a video misses or has beyond its reference (video_no 0) of the same group."""
    ref = segments.filter("video_no = 0").select(*by, "segment_id").distinct()
    own = segments.select(*by, video, "segment_id").distinct()
    videos = own.select(*by, video).distinct()
    wanted = videos.join(ref, by).withColumn("in_ref", F.lit(1))
    both = wanted.join(own.withColumn("in_own", F.lit(1)), [*by, video, "segment_id"], "full")
    out = both.groupBy(*by, video).agg(F.count_if(F.col("in_own").isNull()).alias("missing_segments"), F.count_if(F.col("in_ref").isNull()).alias("extra_segments"))
    return out.withColumn("structural", (F.col("missing_segments") > 0) | (F.col("extra_segments") > 0))


def distances(codes: DataFrame, by: list[str], lengths: dict[str, int], spatial: str | None = None) -> DataFrame:
    """Distances of every segment to its reference's (video_no 0): raw and normalized by stream, and blur loss.

    codes have <stream>_bits; by holds the group columns. The hybrid distance is the sum of the streams'.
    """
    streams = list(lengths)
    coded = codes.select("*", *(V.words(F.col(f"{s}_bits")).alias(f"{s}_words") for s in streams))
    keys = [*by, "segment_id"]
    ref = coded.filter("video_no = 0").select(*keys, *(F.col(f"{s}_words").alias(f"ref_{s}") for s in streams), *([F.col(spatial).alias("ref_values")] if spatial else []))
    joined = coded.join(ref, keys)
    raw = [V.hamming(F.col(f"{s}_words"), F.col(f"ref_{s}")).alias(f"{s}_raw") for s in streams]
    loss = [V.blur_loss(F.col("ref_values"), F.col(spatial)).alias("blur_loss")] if spatial else []
    rest = [c for c in codes.columns if not c.endswith("_bits") and c not in streams]
    out = joined.select(*rest, *raw, *loss)
    return out.select("*", *(V.normalized(F.col(f"{s}_raw"), n).alias(f"{s}_distance") for s, n in lengths.items()))


def video_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and largest value and the lowest segment that reaches it."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.max_by("segment_id", F.struct(F.col(value), -F.col("segment_id"))).alias("max_segment"))


def hash_pairs(reference: DataFrame, query: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Frame hashes paired by sample in segments that both have; a pair is valid or has a reason."""
    segment = [k for k in keys if k != "frame_index"]
    common = reference.select(*segment).distinct().join(query.select(*segment).distinct(), segment, "left_semi")
    side = lambda df, p: df.join(common, segment, "left_semi").select(*keys, F.col("hash64").alias(f"{p}_hash"), F.col("success").alias(f"{p}_ok"), F.col("offset_s").alias(f"{p}_s"))
    joined = side(reference, "ref").join(side(query, "query"), keys, "full")
    reason = F.when(F.col("ref_ok").isNull() | F.col("query_ok").isNull(), "missing").when(~F.col("ref_ok") | ~F.col("query_ok"), "invalid").when(F.abs(F.col("ref_s") - F.col("query_s")) > tolerance, "timestamp").otherwise("valid")
    return joined.withColumn("reason", reason).withColumn("distance", F.when(F.col("reason") == "valid", V.hash_distance(F.col("ref_hash"), F.col("query_hash")) / 64.0))


def hash_segments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and largest distance of the valid pairs; a segment without any valid pair is invalid and has no score."""
    valid = F.count_if(F.col("reason") == "valid")
    out = pairs.groupBy(*by, "segment_id").agg((F.count(F.lit(1)) - valid).alias("invalid_pairs"), F.avg("distance").alias("mean"), F.percentile("distance", 0.5).alias("median"), F.max("distance").alias("largest"), (valid > 0).alias("segment_valid"))
    return out.withColumn("score", F.col("mean"))


def hash_structure(reference: DataFrame, query: DataFrame, by: list[str]) -> DataFrame:
    """A row for every video of either side, with the numbers of segments that the query misses or has besides."""
    ref, qry = (df.select(*by, "segment_id").distinct().withColumn(f"_{s}", F.lit(True)) for df, s in ((reference, "ref"), (query, "query")))
    return ref.join(qry, [*by, "segment_id"], "full").groupBy(*by).agg(F.count_if(F.col("_query").isNull()).alias("missing_segments"), F.count_if(F.col("_ref").isNull()).alias("extra_segments"))


def hash_video_decision(segments: DataFrame, structure: DataFrame, by: list[str], threshold) -> DataFrame:
    """The video score is the largest segment mean; it must exceed the threshold strictly. Videos of `structure` with bad
    evidence, without any score, or with missing or extra segments are abnormal: the decision fails closed."""
    v = segments.groupBy(*by).agg(F.max("score").alias("video_score"), F.bool_or(~F.col("segment_valid")).alias("invalid"))
    v = structure.join(v, by, "left").withColumn("structural", (F.col("missing_segments") > 0) | (F.col("extra_segments") > 0))
    v = v.withColumn("invalid", F.coalesce("invalid", F.lit(True)) | F.col("video_score").isNull()).drop("missing_segments", "extra_segments")
    over = F.coalesce(F.col("video_score") > threshold, F.lit(False))
    # fixed values: the texts of the reasons
    reasons = F.concat_ws(
        "; ",
        F.when(over, "video score strictly exceeds threshold"),
        F.when(F.col("structural"), "missing or extra segment"),
        F.when(F.col("invalid"), "unusable corresponding frame-hash evidence"),
    )
    return v.withColumn("observed", F.when(over | F.col("structural") | F.col("invalid"), "abnormal").otherwise("normal")).withColumn("decision_reason", F.when(reasons == "", "within threshold with complete valid structure").otherwise(reasons))
