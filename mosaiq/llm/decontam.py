"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with single spaces. An item of m characters may occur in a document with up
to floor(error_rate * m) edits: it is split into one piece more than that, of which one at least must then occur as it
is. One automaton finds all exact pieces; a piece hit gives a window, which the q-gram lemma may rule out, and Myers'
bit-parallel distance decides. Whole texts are searched.

Items are a stated query set: they are taken in blocks of at most `block_chars` characters, each sent to all
executors, where a Python worker keeps its automaton. Every document is searched for every block, one pass a block side
by side; `remove` filters in that pass if there is one block, else by the hashes of the texts that were hit. Null and empty items match nothing, null and empty texts
have no match; equal items are separate items; repeated rows are searched alike; null document ids are carried and judged
by their texts; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import slices

ERROR_RATE = 0.1
BLOCK_CHARS = 4 << 20
MATCHES = "doc_id long, item_id long, distance int, item_chars int, start int, end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any part of text, where the first such part ends)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # no cost to start anywhere
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(k, t, int(len(t) * error_rate)) for k, t in ((k, normal(t)) for k, t in items) if t]
        self.grams = [[t[i : i + 3] for i in range(len(t) - 2)] for _, t, _ in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t, e) in enumerate(self.items):
            cuts = [j * len(t) // (e + 1) for j in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, its characters, start, end) of the best occurrence of each item."""
        text = normal(text)
        if not self.any or not text:
            return []
        near: dict[int, set[int]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for i, a in where:
                near.setdefault(i, set()).add(last + 1 - n - a)
        out = []
        for i, starts in near.items():
            key, item, e = self.items[i]
            m, best = len(item), None
            ordered = sorted(starts)
            at = 0
            while at < len(ordered):
                low = high = ordered[at]
                while at + 1 < len(ordered) and ordered[at + 1] <= high + e:
                    at += 1
                    high = ordered[at]
                at += 1
                a, b = max(0, low - e), min(len(text), high + m + e)
                window = text[a:b]
                if (p := window.find(item)) >= 0:
                    best = (0, a + p, a + p + m)
                    break
                if not e:
                    continue
                have = {window[j : j + 3] for j in range(len(window) - 2)}
                if sum(map(have.__contains__, self.grams[i])) < len(self.grams[i]) - 3 * e:
                    continue
                d, end = myers(item, window)
                if d <= e and (best is None or d < best[0]):
                    _, back = myers(item[::-1], window[:end][::-1])
                    best = (d, a + end - back, a + end)
            if best:
                out.append((key, best[0], m, best[1], best[2]))
        return sorted(out)


def blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters, read one block at a time."""
    items = benchmark.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield [(r["k"], r["t"]) for r in part.orderBy("k", "t").collect()]  # about block_chars characters


_KEPT: dict[tuple, Matcher] = {}


def matcher_of(items: list[tuple[int, str]], error_rate: float, name: str) -> Matcher:
    """The block's matcher; a Python worker keeps the last one."""
    if (name, error_rate) not in _KEPT:
        _KEPT.clear()
        _KEPT[name, error_rate] = Matcher(items, error_rate)
    return _KEPT[name, error_rate]


def _passes(rows: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, error_rate: float, block_chars: int, emit, schema) -> list[DataFrame]:
    """For each block of items a pass of emit(matcher, batch) over the rows."""
    out = []
    for items in blocks(benchmark, item_key, item_text, block_chars):
        shared, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "__text"):
                yield emit(matcher_of(shared.value, error_rate, name), batch)

        out.append(rows.mapInArrow(run, schema))
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that occurs in it; start and end count characters of the normal text."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def emit(matcher: Matcher, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(k, *m) for k, t in zip(batch.column("key").to_pylist(), batch.column("__text").to_pylist()) for m in matcher.find(t)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], [c.split()[0] for c in MATCHES.split(", ")])

    return _union(_passes(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("__text")), benchmark, item_key, item_text, error_rate, block_chars, emit, MATCHES))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents in which an item occurs."""

    def keep(matcher: Matcher, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not matcher.find(t) for t in batch.column("__text").to_pylist()], pa.bool_())).select(docs_columns)

    def hits(matcher: Matcher, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([bool(matcher.find(t)) for t in batch.column("__text").to_pylist()], pa.bool_())).select(["__sha"])

    docs_columns = docs.columns
    passes = _passes(docs.select("*", F.col(text).alias("__text")), benchmark, item_key, item_text, error_rate, block_chars, keep, docs.schema)
    if len(passes) == 1:
        return passes[0]
    sha = F.sha2(F.col(text), 256)
    found = _union(_passes(docs.select(sha.alias("__sha"), F.col(text).alias("__text")), benchmark, item_key, item_text, error_rate, block_chars, hits, "__sha string"))
    return docs.withColumn("__sha", sha).join(found.distinct(), "__sha", "left_anti").select(docs_columns)
