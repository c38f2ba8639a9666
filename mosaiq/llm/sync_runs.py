"""Periodic run detection in texts by string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that neither neighbouring
word extends. Words are the stretches without ASCII white space. Periods below 6 are read off directly, by comparing the
words with themselves shifted. For every dyadic scale t = 2, 4, 8 ... the periods from 3 t to 6 t - 1 come from

* the synchronising set of t: positions i where the least hash of the t-word windows that start at i .. i + t, highly
  periodic ones left out, is that of the first or the last of them. Whether i belongs depends on 2 t words only, so both
  copies of a period hold it; two members with equal 2 t words, 3 t to 6 t - 1 apart, propose their distance as a period;
* highly periodic regions (windows of t words with a period up to t / 3), which hold no members: these are runs of
  smaller scales, known by then. Two of them with equal roots that touch propose the distances that bring them into phase.

A proposal is extended word by word in both directions, so hashes propose only and never decide. A stretch that a smaller
period explains has the same ends as the run of that period and goes. Texts in which no 2 t words occur twice are done
after that scale. Rows go through in slices of some megabytes, each text whole; nothing passes between texts.

Null and empty texts have no words and no run, and are "" when collapsed. Repeated rows and null ids are kept; all
columns are carried but those named `runs`, `collapsed` and `n_words`, which the result names itself. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mosaiq.llm.common import let, mix64, ragged_take, slices

LEAST = 12
DIRECT = 6
_SEED = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:long,length:long,period:long>>"


def doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 size words from those of size words; windows that leave the array get a hash of their own."""
    out = mix64(np.arange(len(h), dtype=np.uint64) ^ _SEED)
    out[: len(h) - size] = mix64(h[: len(h) - size] * _PRIME ^ mix64(h[size:]))
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of x[i : i + size] for every i with a full window."""
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def synchronising(h: np.ndarray, size: int, periodic: np.ndarray) -> np.ndarray:
    """Members of the synchronising set; h: hashes of windows of size words, periodic: marks windows that are highly periodic."""
    identity = np.where(periodic, _TOP, mix64(h ^ _SEED) >> np.uint64(1))
    if len(identity) <= size:
        return np.zeros(0, np.int64)
    least = sliding_min(identity, size + 1)
    n = len(least)
    return np.flatnonzero((least != _TOP) & ((least == identity[:n]) | (least == identity[size : size + n])))


def equal_pairs(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of members with equal contexts that are low to high - 1 apart; at ascends."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    starts, gaps, j = [], [], 1
    live = np.arange(len(at) - 1)
    while len(live):
        live = live[live + j < len(at)]
        near = (context[live] == context[live + j]) & (at[live + j] - at[live] < high)
        live = live[near]
        gap = at[live + j] - at[live]
        starts.append(at[live[gap >= low]])
        gaps.append(gap[gap >= low])
        j += 1
    return (np.concatenate(starts), np.concatenate(gaps)) if starts else (np.zeros(0, np.int64),) * 2


def agree(w: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on, in direction step, are equal."""
    total, size = 0, 16
    while True:
        if step > 0:
            n = min(size, len(w) - b)
            differ = w[a : a + n] != w[b : b + n]
        else:
            n = min(size, a + 1)
            differ = (w[a - n + 1 : a + 1] != w[b - n + 1 : b + 1])[::-1]
        if n <= 0:
            return total
        first = int(differ.argmax())
        if differ[first]:
            return total + first
        total += n
        a, b, size = a + step * n, b + step * n, min(size * 4, 1 << 16)


def touching_roots(w: np.ndarray, found: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) that pairs of touching highly periodic regions propose at a scale."""
    at, periods = [], []
    regions = sorted((q, left, right) for left, right, q in found if 3 * q <= size and right - left >= 3 * size)
    for (p, left1, right1), (q, left2, right2) in zip(regions, regions[1:]):
        if p != q or left2 > right1:
            continue
        low = max(left1, right1 - 2 * p + 1)
        root, before = w[left2 : left2 + p].tobytes(), w[low:right1].tobytes()
        place = before.find(root)
        while place > 0 and place % w.itemsize:
            place = before.find(root, place + 1)
        if place < 0:
            continue
        lag = left2 - (low + place // w.itemsize)
        first = lag + p * max(0, -(-(3 * size - lag) // p))
        some = np.arange(first, min(6 * size - 1, right1 - left1, right2 - left2) + 1, p)
        at.append(right1 - some)
        periods.append(some)
    return (np.concatenate(at), np.concatenate(periods)) if at else (np.zeros(0, np.int64),) * 2


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of all rows, by row, start and period. ids: a number for each different word."""
    rows = len(bounds) - 1
    n = np.diff(bounds)
    # a number of its own after each row keeps everything within the row
    width = n + 1
    base = np.concatenate([[0], np.cumsum(width)])
    w = np.empty(int(base[-1]), np.int64)
    inside = np.ones(len(w), bool)
    inside[base[1:] - 1] = False
    w[inside] = ids
    w[~inside] = -1 - np.arange(rows)
    found: dict[tuple[int, int], int] = {}  # (left, right) in w -> period
    for q in range(1, DIRECT):
        if len(w) <= q:
            break
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        left, right = edge[::2], edge[1::2] + q
        keep = right - left >= max(2 * q, 4)
        for a, b in zip(left[keep].tolist(), right[keep].tolist()):
            found.setdefault((a, b), q)
    # rows that may hold longer periods, compacted; shift: place in w less place in the compacted words
    row = np.flatnonzero(n >= 2 * DIRECT)
    part, at = ragged_take(w, base, row)
    start = base[:-1][row]
    h, size = mix64(part.astype(np.uint64) ^ _SEED), 1
    while len(row):
        h, size = doubled(h, size), 2 * size
        wide = doubled(h, size)
        shift = np.repeat(start - at[:-1], np.diff(at))
        known = [(left, right, q) for (left, right), q in found.items() if 3 * q <= size and right - left >= size]
        periodic = np.zeros(len(part), bool)
        if known:
            _mark(periodic, known, size, start, at)
        member = synchronising(h, size, periodic)
        near, gap = equal_pairs(member, wide[member], 3 * size, 6 * size)
        near = near + shift[near]
        touch, more = touching_roots(w, known, size)
        near, gap = np.concatenate([near, touch]), np.concatenate([gap, more])
        order = np.lexsort((near, gap))
        _extend(w, near[order].tolist(), gap[order].tolist(), found)
        # a longer run repeats its first 2 size words
        fits = np.diff(at) - 1 >= 12 * size
        stays = np.flatnonzero(fits)
        if len(stays):
            owner = np.repeat(np.arange(len(row)), np.diff(at))
            of = np.flatnonzero(fits[owner])
            key = wide[of] ^ mix64(owner[of].astype(np.uint64) + np.uint64(1))
            order = np.argsort(key, kind="stable")
            again = key[order][1:] == key[order][:-1]
            stays = np.unique(owner[of[order[1:][again]]])
        part, _ = ragged_take(part, at, stays)
        h, new = ragged_take(h, at, stays)
        row, start, at = row[stays], start[stays], new
    runs = sorted((a, q, b - a) for (a, b), q in found.items() if b - a >= max(LEAST, 2 * q))
    left, period, length = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    of = np.searchsorted(base, left, side="right") - 1
    return of, left - base[of], length, period


def _mark(periodic: np.ndarray, known: list[tuple[int, int, int]], size: int, start: np.ndarray, at: np.ndarray) -> None:
    """Mark the windows of size words that lie in a known region; start and at: places of the compacted rows in w and in the words."""
    left, right, _ = (np.array(c) for c in zip(*known))
    of = np.searchsorted(start, left, side="right") - 1
    held = of >= 0
    held[held] = left[held] < (start + np.diff(at))[of[held]]  # the row is still there
    a = left[held] - start[of[held]] + at[:-1][of[held]]
    edge = np.zeros(len(periodic) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + (right - left)[held] - size + 1, -1)
    periodic |= np.cumsum(edge)[:-1] > 0


def _extend(w: np.ndarray, at: list[int], periods: list[int], found: dict[tuple[int, int], int]) -> None:
    """Extend each proposal, in order of period and place, to its maximal stretch and keep it if no smaller period explains it."""
    period, done = 0, -1
    for a, q in zip(at, periods):
        if q != period:
            period, done = q, -1
        if a < done or w[a] != w[a + q]:  # a lies in a stretch of this period that is known already
            continue
        right = a + agree(w, a, a + q, 1)
        done = right
        left = a - agree(w, a - 1, a + q - 1, -1) if a else a
        if right - left >= q:
            found.setdefault((left, right + q), q)


def kept_words(bounds: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words that stay: those that no run holds after its first period."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    at = bounds[row] + start
    np.add.at(edge, at + period, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:-1] == 0


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, the runs by start and period, and the text collapsed to the words that stay."""
    taken = ("runs", "collapsed", "n_words")
    columns = [c for c in docs.columns if c != text and c not in taken]
    shape = StructType([*(docs.schema[c] for c in columns), *StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            words = pc.ascii_split_whitespace(pc.fill_null(batch.column("__text").cast(pa.large_string()), ""))
            bounds = words.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], words.flatten()
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
            if not full.all():
                flat = flat.filter(pa.array(full))
                bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row, *spans = find_runs(ids, bounds)
            keep = kept_words(bounds, row, *spans)
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
            left = pa.LargeListArray.from_arrays(pa.array(kept), flat if keep.all() else flat.filter(pa.array(keep)))
            struct = pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in spans], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(bounds))), pa.int32()), struct)
            joined = pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(bounds)), runs, joined], [*columns, *("n_words", "runs", "collapsed")])

    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(run, shape)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the least start, then period. Null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which every tenth text by crc32 of the id is periodic from a word on; the other texts stay."""
    space = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        chosen = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, (place(i) + 1).cast("int")))
        return F.when(n > 0, F.array_join(chosen, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col(text), space), lambda w: w != "")
    return docs.withColumn(text, F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col(text)))
