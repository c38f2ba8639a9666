"""Scalar projections: ids, parsed media fields, file-name rules and labels. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transformation names, their classes and display order.
BENIGN = ("avi_conversion", "mov_conversion", "resize_480p", "resize_720p")
TAMPERED = ("blur", "frame_deletion", "frame_insertion", "frame_replacement")
TRANSFORMATIONS = ("trusted_reference", *BENIGN, *TAMPERED)
ATTRIBUTIONS = ("none", "resnet_only", "temporal_only", "both_streams", "structural")
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "m4v")


def safe_id(name: Column) -> Column:
    """Runs of other characters become one underscore; edge dots, dashes and underscores go; empty gives 'video'."""
    cleaned = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("video"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def optional_float(text: Column) -> Column:
    return finite(F.trim(text).try_cast("double"))


def optional_int(text: Column) -> Column:
    """Truncated toward zero."""
    return optional_float(text).try_cast("bigint")


def frame_rate(text: Column) -> Column:
    """'30000/1001' or '25'; null unless finite and positive."""
    parts = F.split(text, "/")
    number = F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.nullif(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)))).otherwise(F.when(F.size(parts) == 1, parts[0].try_cast("double")))
    number = finite(number)
    return F.when(number > 0, number)


def expected_samples(duration: Column, fps: float) -> Column:
    return F.when(duration > 0, F.floor(duration * fps + 1e-9)).otherwise(F.lit(0)).cast("bigint")


def frame_file(video_id: Column, segment_id: Column, frame_index: Column, seconds: Column) -> Column:
    return F.format_string("%s_segment_%03d_frame_%03d_t%07dms.jpg", video_id, segment_id, frame_index, F.bround(seconds * 1000).cast("bigint"))


def microseconds(seconds: Column) -> Column:
    """Half-even, as decimals of the scaled double."""
    return F.bround(seconds * 1_000_000).cast("bigint")


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def compression_profile(extension: Column, width: Column, height: Column) -> Column:
    """'<extension>:<bucket>' by pixels; unknown_res where a side is missing or 0."""
    pixels = width.cast("bigint") * height.cast("bigint")
    bucket = F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), "unknown_res").when(pixels <= 900 * 520, "480p").when(pixels <= 1300 * 760, "720p").otherwise("source_res")
    return F.concat(F.coalesce(F.nullif(F.lower(extension), F.lit("")), F.lit("unknown")), F.lit(":"), bucket)


# The file-name patterns of each transformation.
NAME_PATTERNS = {
    "blur": "blur|blurr|blurred|fblurred",
    "frame_deletion": "delete|deletion|fdelete|frame_del|(^|[_-])del($|[_.-])",
    "frame_insertion": "insert|insertion|nsert|fiinsert",
    "frame_replacement": "replace|replacement|swap|swapped",
}


def classify_exact_one(path: Column) -> Column:
    """The one transformation whose rule holds; 'ambiguous' for several, 'unsupported_video' for none."""
    name, stem, extension = F.lower(file_name(path)), F.lower(file_stem(path)), F.lower(file_extension(path))
    hits = {k: name.rlike(p) for k, p in NAME_PATTERNS.items()}
    hits["frame_deletion"] = hits["frame_deletion"] | stem.isin("del", "fdel")
    hits |= {"resize_480p": stem.contains("480"), "resize_720p": stem.contains("720")}
    hits |= {"avi_conversion": (extension == ".avi") | stem.contains("avi"), "mov_conversion": (extension == ".mov") | stem.contains("mov")}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in hits.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, 0)).when(F.size(found) > 1, "ambiguous").otherwise("unsupported_video")


def classify_confidence(transformation: Column) -> Column:
    return F.when(transformation == "ambiguous", 0.2).when(transformation == "unsupported_video", 0.1).otherwise(0.95)


def classify_first_match(path: Column) -> Column:
    """The first rule that holds."""
    name, stem, extension = F.lower(file_name(path)), F.lower(file_stem(path)), F.lower(file_extension(path))
    return (
        F.when(name == "original.mp4", "trusted_reference")
        .when(name.contains("blur"), "blur")
        .when(name.rlike("delete|deletion"), "frame_deletion")
        .when(name.rlike("replacement|replace"), "frame_replacement")
        .when(name.rlike("insert|nsert"), "frame_insertion")
        .when((extension == ".avi") | stem.contains("avi"), "avi_conversion")
        .when((extension == ".mov") | stem.contains("mov"), "mov_conversion")
        .when(stem.contains("480"), "resize_480p")
        .when(stem.contains("720"), "resize_720p")
        .otherwise("unclassified")
    )


def category_of(transformation: Column) -> Column:
    return F.when(transformation == "trusted_reference", "reference").when(transformation.isin(*BENIGN), "benign").when(transformation.isin(*TAMPERED), "tampered").otherwise("unknown")


def expected_label(transformation: Column) -> Column:
    return F.when(transformation.isin(*TAMPERED), "abnormal").when(transformation.isin("trusted_reference", *BENIGN), "normal").otherwise("unknown")


def transformation_order(transformation: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(list(TRANSFORMATIONS)), transformation), F.lit(0)) - 1, F.lit(99)).cast("int")


def source_id(folder: Column) -> Column:
    return F.concat(F.lit("SRC_"), F.upper(safe_id(folder)))


def fold_id(source: Column) -> Column:
    return F.concat(F.lit("LOSO_"), F.replace(source, F.lit("SRC_"), F.lit("")))


def short_label(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("frame_"), F.lit("")), F.lit("_"), F.lit(" "))


def format_metric(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.format_number(value, digits))
