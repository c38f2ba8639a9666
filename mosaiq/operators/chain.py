"""The comparison chain: gate, alignment, distances, registry joins and predictions for every registered recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import scalars as S
from mosaiq.functions import vectors as V

# The codes of the relative attributions.
ATTRIBUTION_CODES = {"no_difference": 0, "resnet_dominant": 1, "temporal_dominant": 2, "approximately_equal": 3}

#: Properties that a query's digests share with its reference's, and what is said where they do not.
GATED = {
    "quantization_id": "quantization differs from the reference",
    "normalization_id": "normalization differs from the reference",
    "bits": "digest lengths differ from the reference",
    "boundaries": "stream boundaries differ from the reference",
    "bit_order": "bit order differs from the reference",
}

REGISTRY = ["source_id", "video_id", "filename", "reference_video_id", "reference_filename", "transformation", "category", "expected"]


def gate(queries: DataFrame, references: DataFrame, by: list[str], properties: dict[str, str] = GATED) -> DataFrame:
    """Each query with `reason`, the first obstacle to its comparison, or null where there is none.

    references has one row a reference with `valid`, the outcome of its record's verification. A query without a
    reference and one whose reference does not verify are refused; so are properties that differ or are null.
    """
    ref = references.select(*by, F.col("valid").alias("_valid"), *(F.col(p).alias(f"_{p}") for p in properties))
    reason = F.when(F.col("_valid").isNull(), "reference record not found").when(~F.col("_valid"), "reference record does not verify")
    for p, text in properties.items():
        reason = reason.when(~F.coalesce(F.col(p) == F.col(f"_{p}"), F.lit(False)), text)
    return queries.join(ref, by, "left").select(*queries.columns, reason.alias("reason"))


def indexed(segments: DataFrame, by: list[str], label: str) -> DataFrame:
    """Places of the segments in their recording, from 0. A repeated segment is an error: it would join with each copy of its counterpart."""
    order = Window.partitionBy(*by).orderBy("segment_id")
    told = F.concat(F.lit(f"{label} has duplicate segment ids: "), F.to_json(F.struct(*by, "segment_id")))
    place = F.when(F.lag("segment_id").over(order) == F.col("segment_id"), F.raise_error(told).cast("int")).otherwise(F.row_number().over(order) - 1)
    return segments.withColumn("place", place)


def compare(reference: DataFrame, query: DataFrame, by: list[str], video: str, lengths: dict[str, int], tolerance_us: int = 1000) -> DataFrame:
    """Full outer alignment of each query recording with the reference of its group, with distances where segments match.

    Both sides have by, segment_id, start_us, end_us and <stream>_bits; the query has `video` too. Rows carry state,
    places, time deltas (query less reference), raw and normalized distances by stream and of both streams together,
    the balanced score and the relative attribution. The two streams are the keys of lengths. A segment that either side
    repeats is an error.
    """
    first, second = lengths
    if tolerance_us < 0:
        raise ValueError("the tolerance is not negative")
    side = lambda df, p, keys: indexed(df, keys, {"ref": "reference"}.get(p, p)).select(*keys, "segment_id", *(F.col(c).alias(f"{p}_{c}") for c in ("place", "start_us", "end_us")), *(V.words(F.col(f"{s}_bits")).alias(f"{p}_{s}") for s in lengths))
    videos = query.select(*by, video).distinct()
    left = videos.join(side(reference, "ref", by), by)
    both = left.join(side(query, "query", [*by, video]), [*by, video, "segment_id"], "full")
    start, end = F.col("query_start_us") - F.col("ref_start_us"), F.col("query_end_us") - F.col("ref_end_us")
    near = (F.abs(start) <= tolerance_us) & (F.abs(end) <= tolerance_us)
    state = F.when(F.col("query_place").isNull(), "missing_in_query").when(F.col("ref_place").isNull(), "extra_in_query").when(near, "matched").otherwise("timestamp_mismatch")
    out = both.select("*", state.alias("state"), start.alias("start_delta_us"), end.alias("end_delta_us"))
    matched = lambda c: F.when(F.col("state") == "matched", c)
    out = out.select("*", *(matched(V.hamming(F.col(f"ref_{s}"), F.col(f"query_{s}"))).alias(f"{s}_raw") for s in lengths))
    out = out.withColumn("hybrid_raw", F.col(f"{first}_raw") + F.col(f"{second}_raw"))
    out = out.select("*", *(matched(V.normalized(F.col(f"{s}_raw"), n)).alias(f"{s}_distance") for s, n in {**lengths, "hybrid": sum(lengths.values())}.items()))
    label = V.relative_attribution(F.col(f"{first}_distance"), F.col(f"{second}_distance"))
    out = out.withColumn("score", V.balanced_score(F.col(f"{first}_distance"), F.col(f"{second}_distance"))).withColumn("attribution", matched(label))
    codes = F.create_map(*(F.lit(x) for pair in ATTRIBUTION_CODES.items() for x in pair))
    measures = [f"{s}_{m}" for s in (*lengths, "hybrid") for m in ("raw", "distance")]
    return out.select(*by, video, "segment_id", "state", "ref_place", "query_place", F.col("ref_start_us").alias("start_us"), F.col("ref_end_us").alias("end_us"), "start_delta_us", "end_delta_us", *measures, "score", "attribution", codes[F.col("attribution")].alias("attribution_code"))


def structure(compared: DataFrame, by: list[str]) -> DataFrame:
    """State counts of each recording, and whether any segment is missing, extra or displaced."""
    states = ("matched", "missing_in_query", "extra_in_query", "timestamp_mismatch")
    out = compared.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    findings = F.col("missing_in_query") + F.col("extra_in_query") + F.col("timestamp_mismatch")
    return out.withColumn("findings", findings).withColumn("structural", findings > 0)


def summary(compared: DataFrame, by: list[str], streams: list[str]) -> DataFrame:
    """Mean and largest distance of each stream, the hybrid and the score, their segments, and counts by attribution.

    A recording without matched segments has nulls and zero counts. The lowest segment is named among equals.
    """
    measures = {**{s: f"{s}_distance" for s in (*streams, "hybrid")}, "score": "score"}
    at = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col("segment_id")), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("segment_id"))))
    parts = [f for n, c in measures.items() for f in (F.avg(c).alias(f"mean_{n}"), F.max(c).alias(f"max_{n}"))]
    where = [at(c).alias(f"segment_of_max_{n}") for n, c in measures.items() if n != "hybrid"]
    labels = [F.count_if(F.col("attribution") == a).alias(a) for a in ATTRIBUTION_CODES]
    return compared.groupBy(*by).agg(*parts, *where, *labels)


def with_registry(rows: DataFrame, registry: DataFrame, columns: list[str] = REGISTRY) -> DataFrame:
    """Segment or alignment rows with the registry's columns; recordings without a reference are left out."""
    known = registry.filter("reference_video_id is not null").select(*columns)
    return known.join(rows.drop(*(c for c in columns if c in rows.columns and c != "video_id")), "video_id")


def segment_attribution(rows: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """`abnormal` and `label` of segment rows that have `structural`. Without all three thresholds only structure counts."""
    over = {s: F.coalesce(F.col(c) > limits[s], F.lit(False)) for s, c in (("resnet", "resnet_distance"), ("temporal", "temporal_distance"), ("balanced", "score"))}
    known = limits["resnet"].isNotNull() & limits["temporal"].isNotNull() & limits["balanced"].isNotNull()
    larger = F.when(F.col("resnet_distance") >= F.col("temporal_distance"), "resnet_only").otherwise("temporal_only")
    label = F.when(F.col("structural"), "structural").when(~known, "none").when(over["resnet"] & over["temporal"], "both_streams").when(over["resnet"], "resnet_only").when(over["temporal"], "temporal_only").when(over["balanced"], larger).otherwise("none")
    abnormal = F.col("structural") | (known & (over["resnet"] | over["temporal"] | over["balanced"]))
    return rows.withColumn("abnormal", abnormal).withColumn("label", label)


def fold_status(sources: DataFrame, least: int = 3) -> DataFrame:
    """Each held-out source with the number of training sources, `insufficient_sources` below the least."""
    n = sources.agg(F.count(F.lit(1)).alias("_n"))  # one row
    training = (F.col("_n") - 1).cast("bigint")
    return sources.crossJoin(F.broadcast(n)).select(F.col("source_id"), training.alias("training_sources"), F.when(training < least, "insufficient_sources").otherwise("ok").alias("fold_status"))


def predictions(registry: DataFrame, decided: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for every registered recording; `failed`, and never correct, where no segment was compared.

    decided has abnormal and label by segment, findings the number of structural findings by recording. Any finding or
    abnormal segment makes a recording abnormal. The main label is the most frequent, the first by name of equals.
    """
    counts = {a: F.count_if(F.col("abnormal") & (F.col("label") == a)).alias(f"_{a}") for a in S.ATTRIBUTIONS}
    per = decided.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.array_sort(F.collect_list(F.when(F.col("abnormal"), F.col("segment_id")))).alias("abnormal_segments"),
        F.max("resnet_distance").alias("max_resnet"),
        F.max("temporal_distance").alias("max_temporal"),
        F.max("score").alias("max_score"),
        *counts.values(),
    )
    out = registry.join(per, "video_id", "left").join(findings.select("video_id", F.col("findings").alias("_f")), "video_id", "left")
    found = F.coalesce("_f", F.lit(0)).cast("bigint")
    out = out.withColumn("findings", found).withColumn("_structural", F.greatest(F.coalesce("_structural", F.lit(0)), "findings"))
    # most frequent first, then by name: the least of (-count, name)
    ranked = F.array_min(F.filter(F.array(*(F.struct((-F.coalesce(f"_{a}", F.lit(0))).alias("n"), F.lit(a).alias("label")) for a in S.ATTRIBUTIONS)), lambda s: s["n"] < 0))
    compared = F.col("segments").isNotNull()
    out = out.withColumn("observed", F.when(~compared, "failed").when((F.size("abnormal_segments") > 0) | (F.col("findings") > 0), "abnormal").otherwise("normal"))
    out = out.withColumn("correct", F.col("expected").isin("normal", "abnormal") & (F.col("expected") == F.col("observed")))
    out = out.withColumn("main_attribution", F.when(compared, F.coalesce(ranked["label"], F.lit("none"))).otherwise("none"))
    empty = F.array().cast(dict(per.dtypes)["abnormal_segments"])
    return out.withColumn("abnormal_segments", F.coalesce("abnormal_segments", empty)).drop("segments", "_f", *(f"_{a}" for a in S.ATTRIBUTIONS))


def structural_by_source(aligned: DataFrame, transformations: list[str]) -> DataFrame:
    """Segments that are missing, extra or displaced, by source and transformation."""
    rows = aligned.filter(F.col("transformation").isin(*transformations) & (F.col("state") != "matched"))
    return rows.groupBy("source_id", "transformation").agg(F.count(F.lit(1)).alias("findings"))


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", suffix: str = "_summary") -> DataFrame:
    """Join by keys; columns of the right side that the left has too get the suffix. Null keys match each other."""
    clash = set(left.columns) & set(right.columns)
    r = right.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, on, how).drop(*(f"_{k}" for k in keys))


def selected(registry: DataFrame, source_id: str | None = None, video_id: str | None = None) -> DataFrame:
    """A partial run: the recordings of one source, of one recording if named, always with the reference."""
    rows = registry if source_id is None else registry.filter(F.col("source_id") == source_id)
    return rows if video_id is None else rows.filter((F.col("category") == "reference") | (F.col("video_id") == video_id))


def source_lists(registry: DataFrame, expected: list[str]) -> DataFrame:
    """Of each source: benign and tampered types found, expected types that are missing or found twice, and unclear files.

    A source with one reference is valid, others are blocked.
    """
    kinds = registry.groupBy("source_id", "category", "transformation").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("transformation") == "ambiguous").alias("unclear"))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("transformation"))))
    per = kinds.groupBy("source_id").agg(
        pick(F.col("category") == "benign").alias("benign"),
        pick(F.col("category") == "tampered").alias("tampered"),
        pick(F.col("transformation").isin(*expected)).alias("_found"),
        pick(F.col("transformation").isin(*expected) & (F.col("n") > 1)).alias("duplicated"),
        F.sum("unclear").alias("ambiguous_files"),
        F.sum(F.when(F.col("category") == "reference", F.col("n")).otherwise(0)).alias("_refs"),
    )
    missing = F.array_sort(F.array_except(F.lit(expected), "_found"))
    return per.select("source_id", F.when(F.col("_refs") == 1, "valid").otherwise("blocked").alias("status"), "benign", "tampered", missing.alias("missing"), "duplicated", "ambiguous_files")


def byte_copies(registry: DataFrame) -> DataFrame:
    """Each recording with the numbers of its byte-identical copies in its source and, for references, of references elsewhere.

    The group is named by its checksum and first recording, so that a group of n has n rows, not n lists of n - 1.
    """
    own = registry.groupBy("source_id", "sha256").agg((F.count(F.lit(1)) - 1).alias("copies_in_source"), F.min("video_id").alias("first_in_source"))
    refs = registry.filter("category = 'reference'").groupBy("sha256").agg((F.count(F.lit(1)) - 1).alias("_refs"))
    out = registry.select("source_id", "video_id", "sha256", "category").join(own, ["source_id", "sha256"]).join(refs, "sha256", "left")
    originals = F.when(F.col("category") == "reference", F.col("_refs")).otherwise(0)
    return out.select("source_id", "video_id", "copies_in_source", "first_in_source", originals.cast("bigint").alias("equal_references"))
