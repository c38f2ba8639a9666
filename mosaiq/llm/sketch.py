"""Document fingerprints: threshold-scaled sketches of word shingles (DataFrame functions only).

A shingle is five words of the lower-case text between white space (all words of a shorter text). Its 63-bit hash is
kept if it is below a fixed fraction of the range, so the sketch of a union is the union of sketches and the share of
common hashes estimates containment between documents of any lengths. A text whose shingles are all above the
threshold keeps its smallest hash, so that only a text without words has an empty sketch.

Null and empty texts have empty sketches; two empty sketches are alike (1), an empty and another one are not (0).
Repeated rows are kept, each with its own follower: rows of equal ids follow each other by their texts, then sketches.
Null ids come first, as -2 ** 63, and are told from a real id of that value by nothing. Very long texts are shingled
whole. An empty table gives an empty result; only the id and text columns are read, so no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.llm.common import SHINGLE_WORDS, let, shuffle_partitions

FRACTION = 1 / 8
_LONGS = "array<bigint>"


def sketch(text: Column, fraction: float = FRACTION, words: int = SHINGLE_WORDS) -> Column:
    """The sorted distinct shingle hashes of text below fraction of the hash range."""
    limit = F.lit(int(fraction * 2**63))
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def shingled(hashed: Column) -> Column:
        last = F.greatest(F.size(hashed) - (words - 1), F.lit(1))
        every = F.transform(F.sequence(F.lit(1), last), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(hashed, i, words)), 1))
        kept = lambda every: let(F.filter(every, lambda h: h < limit), lambda low: F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(every))))
        return F.when(F.size(hashed) == 0, F.array().cast(_LONGS)).otherwise(F.sort_array(F.array_distinct(let(every, kept))))

    return let(F.transform(parts, lambda w: F.xxhash64(w)), shingled)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both shingle sets together."""
    limit = F.lit(int(fraction * 2**63))
    both = F.sort_array(F.array_union(a, b))
    return let(both, lambda x: let(F.filter(x, lambda h: h < limit), lambda low: F.when((F.size(low) > 0) | (F.size(x) == 0), low).otherwise(F.slice(x, 1, 1))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    return let(F.size(F.array_intersect(a, b)).cast("double"), lambda both: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, key: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Each row with next_<column> of the row that follows by key (null keys first, then ties by the columns); the first row follows the last.

    Rows are dealt by key range, and the first row of every range also goes to the range before it, so neither a global
    sort nor one task over all rows is needed. Range bounds are keys that occur, found by one quantile pass.
    """
    spark, least = docs.sparkSession, -(2**63)
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(least))
    n = buckets or 2 * shuffle_partitions(spark)
    found = docs.select(k.alias("k")).agg(F.min("k").alias("lo"), F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("q")).first()
    bounds = sorted({found["lo"], *(found["q"] or [])} - {None}) or [least]
    starts = F.lit(bounds)
    bucket = F.size(F.filter(starts, lambda b: b <= F.col("_k")))
    copies = F.when(F.array_contains(starts, F.col("_k")), F.array(bucket, F.when(bucket == 1, F.lit(len(bounds))).otherwise(bucket - 1))).otherwise(F.array(bucket))
    dealt = docs.withColumn("_k", k).select("*", F.posexplode(copies).alias("_copy", "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_copy", "_k", *columns)
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter(F.col("_copy") == 0).drop("_k", "_copy", "_bucket")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Sketches of every text and of its edited text, whose second half is the start of the next document, with their likeness."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text"), fraction))
    paired = with_next(base, "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", sketch(F.col("edited"), fraction).alias("edited_sketch"))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
