"""The registry of recordings, from listed files to ids, references and the comparison of each recording with its reference.

A folder is a source. Files of one folder that get the same transformation are numbered in the order of their lower-case names,
then of the names themselves. Rows of a null folder form one source, named as an empty name is, without a reference; a file
listed twice is two recordings. Ids are unique but where names that are told apart only by other characters than letters and
digits meet, or an unrecognized file is called like a known ending: `validation` finds those. An empty list gives an empty registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import scalars as S

# What the ids of recordings end in.
ENDINGS = {
    "trusted_reference": "ORIGINAL",
    "avi_conversion": "AVI",
    "mov_conversion": "MOV",
    "resize_480p": "480P",
    "resize_720p": "720P",
    "blur": "BLUR",
    "frame_deletion": "FRAME_DELETE",
    "frame_insertion": "FRAME_INSERT",
    "frame_replacement": "FRAME_REPLACEMENT",
}
NO_REFERENCE = "source blocked due to reference ambiguity"
AMBIGUOUS = "multiple filename patterns matched"
UNSUPPORTED = "supported extension but expected transformation was not recognized"
IDENTICAL, CHANGED = "byte-for-byte identical", "file bytes changed; checksum mismatch cannot distinguish benign conversion from tampering"


def prefix(folder: Column) -> Column:
    return F.upper(S.safe_id(folder))


def reference_id(folder: Column) -> Column:
    return F.concat(prefix(folder), F.lit("_ORIGINAL"))


def recording_id(folder: Column, transformation: Column, filename: Column, number: Column) -> Column:
    """The folder, what the recording's transformation ends in (the file's stem where it has none), and the number from the second on."""
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    ending = F.coalesce(F.try_element_at(known, transformation), F.upper(S.safe_id(S.file_stem(filename))))
    return F.concat(prefix(folder), F.lit("_"), ending, F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise(""))


def build(videos: DataFrame, references: DataFrame) -> DataFrame:
    """A row a file of `videos` (folder, filename) with the folder's chosen reference (folder, reference, status): ids, transformation, category, label, confidence and notes."""
    chosen = references.select(F.col("folder").alias("_folder"), F.col("reference").alias("_reference"), "status")
    rows = videos.join(chosen, F.col("folder").eqNullSafe(F.col("_folder")), "left").drop("_folder")
    is_reference = F.coalesce(F.col("filename") == F.col("_reference"), F.lit(False))
    rows = rows.withColumn("transformation", F.when(is_reference, "trusted_reference").otherwise(S.classify_exact_one(F.col("filename"))))
    number = F.row_number().over(Window.partitionBy("folder", "transformation").orderBy(F.lower("filename"), "filename"))
    kind = F.when(F.col("transformation") == "ambiguous", "ambiguous").when(F.col("transformation") == "unsupported_video", "unsupported").otherwise(S.category_of(F.col("transformation")))
    notes = F.array_compact(F.array(F.when(F.col("status") == "blocked", NO_REFERENCE), F.when(F.col("transformation") == "ambiguous", AMBIGUOUS), F.when(F.col("transformation") == "unsupported_video", UNSUPPORTED)))
    return rows.select(
        "*",
        S.source_id(F.col("folder")).alias("source_id"),
        recording_id(F.col("folder"), F.col("transformation"), F.col("filename"), number).alias("video_id"),
        F.when(F.col("_reference").isNotNull(), reference_id(F.col("folder"))).alias("reference_video_id"),
        F.col("_reference").alias("reference_filename"),
        kind.alias("category"),
        S.expected_label(F.col("transformation")).alias("expected"),
        F.when(F.col("transformation") == "trusted_reference", 1.0).otherwise(S.classify_confidence(F.col("transformation"))).alias("confidence"),
        notes.alias("notes"),
    ).drop("_reference")


def with_reference(registry: DataFrame, columns: list[str], source: str = "source_id", name: str = "reference") -> DataFrame:
    """Each recording with its source's reference as a struct, null where there is none; two references of one source are an error that names it."""
    several = F.raise_error(F.concat(F.lit("several references of "), F.coalesce(F.first(source).cast("string"), F.lit("null"))))
    one = F.when(F.count(F.lit(1)) > 1, several.cast(registry.select(F.struct(*columns)).schema[0].dataType)).otherwise(F.first(F.struct(*columns)))
    found = registry.filter("category = 'reference'").groupBy(F.col(source).alias("_source")).agg(one.alias(name))
    return registry.join(found, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def metadata_comparison(registry: DataFrame, deltas: list[str], beside: list[str], carried: list[str] = []) -> DataFrame:
    """Numbers with the reference's value and the difference, columns with the reference's value, and further columns; null where a side is missing."""
    found = with_reference(registry, [*deltas, *beside])
    pairs = [c for n in deltas for c in (F.col(n), F.col("reference")[n].alias(f"reference_{n}"), (F.col(n) - F.col("reference")[n]).alias(f"{n}_delta"))]
    return found.select("source_id", "video_id", *pairs, *(c for n in beside for c in (F.col(n), F.col("reference")[n].alias(f"reference_{n}"))), *carried)


def byte_baseline(registry: DataFrame) -> DataFrame:
    """Whether a recording has its reference's bytes: false without a reference, true if both have no digest."""
    found = with_reference(registry, ["sha256"])
    same = F.col("reference").isNotNull() & F.col("sha256").eqNullSafe(F.col("reference.sha256"))
    return found.select("source_id", "video_id", F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("reference.sha256", F.lit("")).alias("original_sha256"), same.alias("matches_original"), F.when(same, IDENTICAL).otherwise(CHANGED).alias("interpretation"))
