"""Line dedup by content-defined line chunks.

A document's lines are hashed; a rolling hash over the last WINDOW line hashes ends a chunk where it is divisible by
DIVISOR, so an inserted or deleted line moves the bounds of the chunks around it only. Chunks of two lines or more that
occur again, in any document, are compared byte by byte with the first occurrence (by id, then hash of the text, then line)
and removed where they are equal. Single lines are never removed, so common short lines stay.

Null and empty texts have no chunk of two lines and stay as they are. Null ids sort first. Repeated rows with equal or
null ids are separate documents only if their texts differ: a document is an id and a hash of its text. Very long texts are cut whole; a run without bounds is cut every
MOST_LINES lines. Empty tables give empty results. Other columns are carried through `dedup` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mosaiq.llm.common import materialize, mix64, slices

WINDOW, DIVISOR, MOST_LINES = 2, 3, 32
_NULL_ID = -(2**63)


def cuts(lines: list[str], window: int = WINDOW, divisor: int = DIVISOR, most: int = MOST_LINES) -> list[int]:
    """Where chunks end: line numbers, the last one len(lines)."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    rolled = h.copy()
    for j in range(1, window):
        rolled[j:] = mix64(rolled[j:] * np.uint64(0x100000001B3) ^ h[:-j])
    out, start = [], 0
    for end in [*(np.flatnonzero(mix64(rolled) % np.uint64(divisor) == 0) + 1).tolist(), len(lines)]:
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= 2 or end == len(lines) and end > start:
            out.append(end)
            start = end
    return out


def _document(key: str, text: str) -> list[Column]:
    """What tells documents apart: the id and, for repeated and null ids, a hash of the text."""
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("version")]


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every chunk of two lines or more: its 128-bit hash, document and lines."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for k, v, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                if not t or "\n" not in t:
                    continue
                lines, start = t.split("\n"), 0
                for end in cuts(lines):
                    if end - start >= 2:
                        h = xxhash.xxh3_128_digest("\n".join(lines[start:end]))
                        out.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), k, v, start, end))
                    start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h1", "h2", "doc_id", "version", "first", "last"])

    rows = docs.select(*_document(key, text), F.col(text).alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, version long, first int, last int")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, spans): the line ranges of each document that repeat an earlier chunk, checked byte by byte."""
    found = materialize(chunks(docs, key, text), "line-chunks")
    place = F.struct("doc_id", "version", "first", "last")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = materialize(firsts, "line-chunk-firsts")
    again = found.join(firsts, ["h1", "h2"]).filter(place != F.col("at")).select("h1", "h2", "doc_id", "version", "first", "last", F.lit(False).alias("is_first"))
    wanted = again.unionByName(firsts.select("h1", "h2", "at.*", F.lit(True).alias("is_first")))
    by_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("h1", "h2", "first", "last", "is_first")).alias("wanted"))
    texts = docs.select(*_document(key, text), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for k, v, t, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "wanted"))):
                lines = (t or "").split("\n")
                out += [(w["h1"], w["h2"], k, v, w["first"], w["last"], w["is_first"], "\n".join(lines[w["first"] : w["last"]])) for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], ["h1", "h2", "doc_id", "version", "first", "last", "is_first", "lines"])

    cut_out = texts.join(by_doc.hint("shuffle_hash"), ["doc_id", "version"]).mapInArrow(cut, "h1 long, h2 long, doc_id long, version long, first int, last int, is_first boolean, lines string")
    cut_out = materialize(cut_out, "line-chunk-texts")
    one = cut_out.filter("is_first").select("h1", "h2", F.col("lines").alias("first_lines"))
    same = cut_out.filter("not is_first").join(one, ["h1", "h2"]).filter(F.col("lines") == F.col("first_lines"))
    return same.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def kept_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """(what is left, lines removed)."""
    lines = text.split("\n")
    drop = {i for a, b in spans for i in range(a, b)}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated chunks taken out of the text, and lines_removed and spans_removed (null-safe: 0 where none)."""
    spans = repeated(docs, key, text).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("spans").alias("__spans")).hint("shuffle_hash")
    same = (F.coalesce(docs[key].cast("bigint"), F.lit(_NULL_ID)) == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__version"))
    joined = docs.join(spans, same, "left").drop("__id", "__version")
    columns = [c for c in docs.columns if c not in ("lines_removed", "spans_removed")]
    at = columns.index(text)
    schema = StructType([*(docs.schema[c] for c in columns), StructField("lines_removed", LongType()), StructField("spans_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, n, s = [], [], []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist()):
                left, removed = (t, 0) if t is None or not spans else kept_lines(t, [(x["first"], x["last"]) for x in spans])
                texts.append(left)
                n.append(removed)
                s.append(len(spans or ()))
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(s, pa.int64())], [*columns, "lines_removed", "spans_removed"])

    return joined.select(*columns, "__spans").mapInArrow(run, schema)

