"""Exact substring dedup by a hash-compared suffix sort.

Every byte of a text that lies in a string of `length` bytes that also starts earlier (smaller id, or same document and
earlier start) is removed; strings are judged on the input and never cross documents.

Suffixes are compared by prefix polynomial hashes: a binary search finds their common extension, so a comparison takes
log(length) steps, and a stable mergesort puts equal strings side by side, earliest first. Neighbours that the hashes
call equal are compared byte by byte. Only suffixes that can have an equal are sorted:

1. In each string the least of the hashes of its `gram`-byte pieces is its anchor. Equal strings have equal anchors at
   the same offset. Strings of one document with one anchor form a run; runs are grouped by anchor hash.
2. Runs of equal bytes repeat the earliest of them entirely. They are told by a SHA-256 digest of the bytes (128 bits of
   it), so collisions of the polynomial hashes cannot make different runs equal.
3. Anchors under which different runs remain send those runs' bytes to the sort, group by group. Groups of more than
   `hot` runs are split by the strings themselves, by the same rule, in DataFrame operations.

A null text is empty and has nothing to remove. Null ids come first. Rows with equal or null ids are separate documents
if their texts differ, in the order of a hash of the text; rows with equal texts too are one document. Very long texts are cut into overlapping
segments, so memory is bounded. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import materialize, mix64, shuffle_partitions, slices

LENGTH, GRAM, HOT = 100, 32, 20_000
SEGMENT = 4 << 20
_PLACE_BITS = 24  # of the places in a segment
_NULL_ID = -(2**63)
_BASE = 0xD1342543DE82EF95
_U = np.uint64
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(n, np.uint64)
            p[1:] = _U(base)
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class PrefixHashes:
    """Hashes of all substrings of a buffer from one pass."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOLS[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes from a and from b are equal, up to most, by binary search on the hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        while len(a) and (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """1, 0 or -1: whether the most bytes from a sort after, as or before those from b."""
        n = self.extension(a, b, most)
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        return np.where(n >= most, 0, np.sign(x.astype(np.int16) - y.astype(np.int16)))


def merge_sort(hashes: PrefixHashes, at: np.ndarray, part: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes at by their first most bytes within equal (neighbouring) values of part; stable."""
    n = len(at)
    order = np.arange(n)
    if n < 2:
        return order
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    size = np.diff(np.append(first, n))
    of = np.repeat(np.arange(len(first)), size)
    inside, start, count = np.arange(n) - first[of], first[of], size[of]
    width = 1
    while width < size.max():
        run = inside // width
        mate = run ^ 1
        low = start + mate * width
        high = np.minimum(low + width, start + count)
        live = np.flatnonzero(low < high)
        left = (run[live] & 1) == 0
        x, lo, hi = at[order[live]], low[live], high[live].copy()
        lo0, lo = lo, lo.copy()
        todo = np.arange(len(live))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            sign = hashes.after(x[todo], at[order[mid]], most)
            # of equals the left run's come first
            go = np.where(left[todo], sign > 0, sign >= 0)
            lo[todo] = np.where(go, mid + 1, lo[todo])
            hi[todo] = np.where(go, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = np.arange(n)
        own = inside[live] % width
        base = start[live] + (run[live] & ~1) * width
        place[live] = base + own + (lo - lo0)
        new = np.empty(n, np.int64)
        new[place] = order
        order = new
        width *= 2
    return order


def repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each start occurs earlier in its group; starts are given in order within each group."""
    hashes = PrefixHashes(data)
    key = np.zeros(len(at), np.uint64)
    for j in range(8):
        key = key << _U(8) | data[at + j].astype(np.uint64)
    rough = np.lexsort((np.arange(len(at)), key, group))
    same_key = (key[rough][1:] == key[rough][:-1]) & (group[rough][1:] == group[rough][:-1])
    part = np.cumsum(np.append(True, ~same_key))
    alone = np.append(True, ~same_key) & np.append(~same_key, True)
    rough, part = rough[~alone], part[~alone]
    out = np.zeros(len(at), bool)
    if not len(rough):
        return out
    order = rough[merge_sort(hashes, at[rough], part, length)]
    a, b = at[order[:-1]], at[order[1:]]
    pairs = np.flatnonzero((part[1:] == part[:-1]) & (hashes.of(a, a + length) == hashes.of(b, b + length)))
    equal = np.ones(len(pairs), bool)
    for j in range(length):  # byte by byte
        equal &= data[a[pairs] + j] == data[b[pairs] + j]
    if equal.all():
        out[order[1:][pairs]] = True
        return out
    seen: set = set()  # a collision: by the bytes themselves
    for i in np.lexsort((np.arange(len(at)), group)).tolist():
        k = (int(group[i]), data[at[i] : at[i] + length].tobytes())
        out[i] = k in seen
        seen.add(k)
    return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, digest of the run in two parts, first string, number of strings) of the runs of the pieces data[starts:ends]."""
    none = np.zeros(0, np.int64)
    nothing = (none.astype(np.uint64), none, none, none, none)
    width = length - gram + 1
    if len(data) < length:
        return nothing
    assert len(data) < 1 << _PLACE_BITS, "a place has no room in its key"
    hashes = PrefixHashes(data)
    n = len(data) - gram + 1
    h = mix64((hashes.sums[gram:] - hashes.sums[:n]) * hashes.down[:n])
    key = h >> _U(_PLACE_BITS) << _U(_PLACE_BITS) | np.arange(n, dtype=np.uint64)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    cut = padded.reshape(-1, width)
    before = np.minimum.accumulate(cut, axis=1).ravel()
    after = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = len(data) - length + 1
    least = np.minimum(after[:strings], before[width - 1 : width - 1 + strings])
    valid = np.zeros(len(data) + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, ends[whole] - length + 1, -1)
    valid = np.cumsum(valid)[:strings] > 0
    new = np.append(True, least[1:] != least[:-1]) | np.append(True, ~valid[:-1])
    first = np.flatnonzero(new & valid)
    if not len(first):
        return nothing
    stop = np.append(valid[1:] & ~new[1:], False)
    last = np.flatnonzero(valid & ~stop)
    anchor = (least[first] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    count = last - first + 1
    raw, sha = data.tobytes(), hashlib.sha256
    digests = np.frombuffer(b"".join([sha(raw[a:b]).digest() for a, b in zip(first.tolist(), (last + length).tolist())]), "<i8").reshape(-1, 4)
    return h[anchor], digests[:, 0] ^ (anchor - first), digests[:, 1], first, count


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, run, run2, doc_id, version, at, n, done) of all runs; done: an equal run of the same batch is earlier."""

    def emit(keys: np.ndarray, versions: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
        h, whole, whole2, first, n = runs(data, starts, ends, length, gram)
        piece = np.searchsorted(starts, first, "right") - 1
        doc, version, at = keys[piece], versions[piece], first - starts[piece] + shift[piece]
        order = np.lexsort((at, version, doc, h, whole2, whole))
        same = np.append(False, np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (whole, whole2, h)]))
        place = np.stack([doc, version, at])[:, order]
        earliest = place[:, np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = np.zeros(len(first), bool)
        again[order] = (place != earliest).any(axis=0)  # a repeated row does not repeat itself
        # settled rows need no group: deal them evenly
        h = np.where(again, mix64(doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + at.astype(np.uint64)), h)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(whole), pa.array(whole2), pa.array(doc), pa.array(version), pa.array(at), pa.array(n.astype(np.int32)), pa.array(again)], ["h", "run", "run2", "doc_id", "version", "at", "n", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT):
            keys, versions = batch.column("key").to_numpy(), batch.column("version").to_numpy()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            size = np.array([len(t) for t in texts])
            short = np.flatnonzero(size <= SEGMENT)  # less than SEGMENT together, but for one row
            if len(short):
                ends = np.cumsum(size[short], dtype=np.int64)
                yield emit(keys[short], versions[short], np.frombuffer(b"".join(texts[i] for i in short), np.uint8), ends - size[short], ends, np.zeros(len(short), np.int64))
            for i in np.flatnonzero(size > SEGMENT).tolist():
                for low in range(0, len(texts[i]) - length + 1, SEGMENT):
                    part = np.frombuffer(texts[i][low : low + SEGMENT + length - 1], np.uint8)
                    yield emit(keys[i : i + 1], versions[i : i + 1], part, np.zeros(1, np.int64), np.array([len(part)]), np.array([low]))

    return docs.mapInArrow(run, "h long, run long, run2 long, doc_id long, version long, at long, n int, done boolean")


def settle(rows: DataFrame) -> DataFrame:
    """Rows come sorted by h, run, run2, doc_id, version, at. Later equal runs are settled (done); runs whose anchor has others stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last first run and whether its anchor has others before it
        last: tuple | None = None
        earliest: tuple | None = None  # the place of the first of the last run's equals
        for batch in batches:
            h, whole, whole2, doc, version, at, n = (batch.column(c).to_numpy() for c in ("h", "run", "run2", "doc_id", "version", "at", "n"))
            done = batch.column("done").to_numpy(zero_copy_only=False)
            open_ = np.flatnonzero(~done)
            if len(open_):
                name = np.stack([h, whole, whole2])[:, open_]
                same = np.append(last == tuple(name[:, 0].tolist()), (name[:, 1:] == name[:, :-1]).all(axis=0))
                last = tuple(name[:, -1].tolist())
                place = np.stack([doc, version, at])[:, open_]
                head = np.maximum.accumulate(np.where(same, -1, np.arange(len(open_))))
                of = place[:, np.maximum(head, 0)]
                if earliest is not None:
                    of[:, head < 0] = np.array(earliest)[:, None]
                earliest = tuple(of[:, -1].tolist())
                later = (place != of).any(axis=0)
                done[open_[same & later]] = True
                itself = np.zeros(len(h), bool)  # the same place by a repeated row
                itself[open_[same & ~later]] = True
            else:
                itself = np.zeros(len(h), bool)
            out = [np.stack([h, doc, version, at, n.astype(np.int64), np.zeros(len(h), np.int64)])[:, done]]
            first = np.flatnonzero(~done & ~itself)
            if len(first):
                f = np.stack([h, doc, version, at, n.astype(np.int64), np.ones(len(h), np.int64)])[:, first]
                shared = np.zeros(f.shape[1] + 1, bool)
                if held is not None:
                    f, shared = np.hstack([held[0], f]), np.zeros(f.shape[1] + 2, bool)
                    shared[0] = held[1]
                same = f[0][1:] == f[0][:-1]
                shared[1:-1] |= same
                both = shared[:-1].copy()
                both[:-1] |= same
                out.append(f[:, :-1][:, both[:-1]])
                held = [f[:, -1:], bool(shared[-2])]
            got = np.hstack(out)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["h", "doc_id", "version", "at", "n", "open"])
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["h", "doc_id", "version", "at", "n", "open"])

    return rows.mapInArrow(run, "h long, doc_id long, version long, at long, n long, open long")


def sort_groups(rows: DataFrame, length: int) -> DataFrame:
    """rows (h, doc_id, version, at, n, bytes) sorted by h, doc_id, version, at -> the strings (doc_id, version, at, n) that occur earlier in their group."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        data = np.frombuffer(b"".join(r[5] for r in held), np.uint8)
        size = np.array([len(r[5]) for r in held])
        n = np.array([r[4] for r in held])
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(held)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = np.array([r[0] for r in held])
        hit = np.flatnonzero(repeats(data, begin[row] + inside, h[row], length))
        if not len(hit):
            return None
        new = np.append(True, (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
        first = hit[new]
        count = np.diff(np.append(np.flatnonzero(new), len(hit)))
        doc, version, at = (np.array([r[i] for r in held]) for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(version[row[first]]), pa.array(at[row[first]] + inside[first]), pa.array(count)], ["doc_id", "version", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        strings = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "version", "at", "n", "bytes"))):
                if held and held[-1][:4] == r[:4]:  # a repeated row
                    continue
                if strings > 100_000 and held[-1][0] != r[0]:
                    if (got := solve(held)) is not None:
                        yield got
                    held, strings = [], 0
                held.append(r)
                strings += r[4]
        if held and (got := solve(held)) is not None:
            yield got

    return rows.mapInArrow(run, "doc_id long, version long, at long, n long")


def sort_hot(rows: DataFrame, length: int) -> DataFrame:
    """As sort_groups for groups of any size: strings are dealt by their bytes, with partial minima."""
    strings = rows.select("doc_id", "version", "at", "bytes", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).select("doc_id", "version", (F.col("at") + F.col("i")).alias("at"), F.substring("bytes", F.col("i") + 1, F.lit(length)).alias("string"))
    place = F.struct("doc_id", "version", "at")
    firsts = strings.groupBy("string").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return strings.join(firsts, "string").filter(place != F.col("first")).select("doc_id", "version", "at", F.lit(1).cast("bigint").alias("n"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: (key, version, text), never null. (key, version, spans): the starts and numbers of repeated strings of each document."""
    n = shuffle_partitions(docs.sparkSession)
    dealt = anchored(docs, length, gram).repartition(n, "h").sortWithinPartitions("h", "run", "run2", "doc_id", "version", "at")
    settled = materialize(settle(dealt), "suffix-runs")
    whole = settled.filter("open = 0").select("doc_id", "version", "at", "n")
    open_ = settled.filter("open = 1")
    large = materialize(open_.groupBy("h").count().filter(F.col("count") > hot).select("h"), "suffix-hot")
    by_doc = open_.join(large.withColumn("hot", F.lit(True)), "h", "left").groupBy("doc_id", "version").agg(F.collect_list(F.struct("h", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT):
            out = []
            for k, v, t, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "version", "text", "wanted"))):
                raw = t.encode()
                out += [(w["h"], k, v, w["at"], w["n"], w["hot"], raw[w["at"] : w["at"] + w["n"] - 1 + length]) for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["h", "doc_id", "version", "at", "n", "hot", "bytes"])

    joined = docs.join(by_doc.withColumnRenamed("doc_id", "key").hint("shuffle_hash"), ["key", "version"])
    texts = joined.mapInArrow(cut, "h long, doc_id long, version long, at long, n long, hot boolean, bytes binary")
    texts = materialize(texts, "suffix-bytes")
    cold = sort_groups(texts.filter("not hot").repartition(n, "h").sortWithinPartitions("h", "doc_id", "version", "at").select("h", "doc_id", "version", "at", "n", "bytes"), length)
    found = whole.unionByName(cold).unionByName(sort_hot(texts.filter("hot"), length))
    return found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("spans")).withColumnRenamed("doc_id", "key")


def kept(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """(the bytes that are left, bytes removed, maximal removed runs)."""
    parts, at, removed, n = [], 0, 0, 0
    end = -1
    for a, b in sorted((a, a + k - 1 + length) for a, k in spans):
        if a > end:
            n += 1
            parts.append(text[max(at, 0) : a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    parts.append(text[max(at, 0) :])
    return b"".join(parts), removed, n


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is binary, since a string may end within a character."""
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NULL_ID)).alias("key"), F.xxhash64(text).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = spans(rows, length, gram, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT):
            out = []
            for k, t, s in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                raw = t.encode()
                left, removed, n = kept(raw, [(x["at"], x["n"]) for x in s], length) if s else (raw, 0, 0)
                out.append((None if k == _NULL_ID else k, len(raw), removed, n, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(found.hint("shuffle_hash"), ["key", "version"], "left")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
