"""Token-id files compressed by a Re-Pair grammar.

Documents are dealt by ascending id into ranges, one file each; a range is a sequence of shards of about SHARD_TOKENS ids
(whole documents). Each shard has a grammar of its own: its most frequent neighbouring pairs are replaced by
nonterminals, round after round, until no pair can be replaced MIN_COUNT times. A round replaces every pair that no more
frequent pair overlaps at that place. Rules never join ids of two documents. A shard stores its symbols, rules, expansion
lengths, its first and last document id and the ids and symbols of each document, so any range of any document is decoded
from the one shard that holds it, without expanding the rest.

Files are Parquet with binary payloads, written by Spark's committer. A null text counts as empty and holds the end id
only; null ids sort first; equal ids are ordered by text; repeated rows are written as often as they come; an empty table
gives no rows; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.llm.bpe import _LETTERS, UNUSUAL, ChunkIds, byte_symbols, ids_of_chunks, loaded, plain, vocabulary
from mosaiq.llm.common import ragged_take, shuffle_partitions, slices

END_ID = 2
SHARD_TOKENS = 1 << 20
#: A rule costs two symbols and a length, so a pair must be replaced four times to pay.
MIN_COUNT = 4
_BUCKET_BITS = 20
SCHEMA = "range int, shard int, first_id long, last_id long, start long, n_tokens long, base long, doc_ids array<long>, doc_tokens array<int>, doc_symbols array<int>, symbols binary, rules binary, lengths binary"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class LibraryEncoder:
    """The tokenizers library with a memory of chunks: usual texts are cut before single spaces and line ends, where the byte-level pre-tokenizer always cuts."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.table = {i: s for i, s in enumerate(byte_symbols())}
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.chunks = ChunkIds()

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():  # one word: one piece
            if chunk.isascii():
                word = "Ġ" + chunk[1:] if chunk[0] == " " else chunk
            else:
                word = chunk.encode().decode("latin-1").translate(self.table)
            return tuple([t.id for t in self.library.model.tokenize(word)])
        return self.pieces_ids(chunk)

    def pieces_ids(self, chunk: str) -> tuple[int, ...]:
        run, table = self.library.model.tokenize, self.table
        return tuple([t.id for w in _PIECES.findall(chunk) for t in run(w.encode().decode("latin-1").translate(table))])

    @staticmethod
    def usual(text: str, simple: bool) -> bool:
        return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or not simple and UNUSUAL.search(text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds). The mark \x02 stands where a chunk begins."""
        simple = plain(texts)
        usual = [self.usual(t, p) for t, p in zip(texts, simple)]
        short = [t.replace(" ", "\x02 ").replace("\n", "\x02\n\x02") if u else "" for t, u in zip(texts, usual)]
        split = pc.split_pattern(pa.array([s.replace(".", "\x02.").replace(",", "\x02,") if u and p else s for s, u, p in zip(short, usual, simple)], pa.large_string()), "\x02")
        ids, bounds = ids_of_chunks(split, self.chunks, self.chunk_ids)
        if not all(usual):
            odd = iter(self.library.encode_batch_fast([t for t, u in zip(texts, usual) if not u], add_special_tokens=False))
            each = [ids[bounds[i] : bounds[i + 1]] if u else np.array(next(odd).ids, np.int32) for i, u in enumerate(usual)]
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds


def compress(ids: np.ndarray, base: int, end: int = END_ID, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules of shape (n, 2), expansion lengths): nonterminals count from base on.

    Counts are kept by buckets of a hash, which can only overrate a pair; what is replaced has been counted exactly. A
    pair below min_count never rises again, so a round looks at the places that are still open and at changed ones only:
    symbols keep their places to the end and are chained to their neighbours.
    """
    s = ids.astype(np.uint32)
    n = len(s)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # n is beyond the last, -1 before the first
    alive = np.ones(n, bool)
    rules, size = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    top, open_, first = base, np.arange(n - 1, dtype=np.int32), np.empty(1 << _BUCKET_BITS, np.uint64)
    while len(open_):
        bits = min(_BUCKET_BITS, int(len(open_)).bit_length() + 1)
        a, b = s[open_], s[after[open_]]
        bucket = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        count = np.bincount(bucket, minlength=1 << bits)[bucket]
        often = (count >= min_count) & (a != end) & (b != end)
        open_, rank = open_[often], count[often] << bits | bucket[often]
        if not len(open_):
            break
        touches = np.append(False, open_[1:] == after[open_[:-1]])
        left = np.where(touches, np.append(0, rank[:-1]), 0)
        right = np.where(np.append(touches[1:], False), np.append(rank[1:], 0), 0)
        i = np.arange(len(open_))
        run = np.maximum.accumulate(np.where(left == rank, 0, i))  # of one pair over and over: every other place
        best = np.flatnonzero((rank >= right) & ((i - run) % 2 == 0) & (rank > left[run]))
        at, box = open_[best], rank[best] & ((1 << bits) - 1)
        pair = s[at].astype(np.uint64) << np.uint64(32) | s[after[at]]
        first[box[::-1]] = pair[::-1]
        own = pair == first[box]  # of two pairs in a bucket the later one waits
        count = np.bincount(box[own], minlength=1 << bits)
        use = own & (count[box] >= min_count)
        if not use.any():  # held up by pairs that share a bucket: go on without what is rare by itself, else without these places
            _, which, times = np.unique(s[open_].astype(np.uint64) << np.uint64(32) | s[after[open_]], return_inverse=True, return_counts=True)
            often = times[which] >= min_count
            open_ = np.delete(open_, best) if often.all() else open_[often]
            continue
        new = np.flatnonzero(count >= min_count)
        rule = np.stack([first[new] >> np.uint64(32), first[new] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        name = np.empty(1 << bits, np.uint32)
        name[new] = top + np.arange(len(new))
        at = at[use]
        s[at] = name[box[use]]
        gone = after[at]
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        changed = np.concatenate([at, before[at]])
        if len(open_) > n >> 6:
            live = np.zeros(n + 1, bool)
            live[open_] = live[changed] = True
            open_ = np.flatnonzero(live[:n] & alive).astype(np.int32)
        else:
            open_ = np.unique(np.concatenate([open_, changed]))
            open_ = open_[(open_ >= 0) & alive[open_]]
        if len(open_) and after[open_[-1]] == n:  # the last symbol has no neighbour
            open_ = open_[:-1]
        size = np.append(size, np.where(rule >= base, np.append(size, 0)[np.maximum(rule.astype(np.int64) - base, 0)], 1).sum(1))
        rules.append(rule)
        top += len(new)
    return s[alive], np.concatenate(rules), size


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols: the rules' right sides are expanded level by level, the symbols are looked up in them."""
    parts, size = rules.ravel().astype(np.int64), np.full(len(rules), 2)
    while len(at := np.flatnonzero(parts >= base)):  # none without rules
        wide = np.ones(len(parts), np.int64)
        wide[at] = 2
        size = np.add.reduceat(wide, np.cumsum(size) - size)
        out = np.repeat(parts, wide)
        first = at + np.arange(len(at))
        rule = rules[parts[at] - base]
        out[first], out[first + 1] = rule[:, 0], rule[:, 1]
        parts = out
    s = symbols.astype(np.int64)
    used = np.unique(s[s < base])  # terminals stand for themselves
    rows = np.where(s < base, len(size) + np.searchsorted(used, s), s - base)
    bounds = np.concatenate([[0], np.cumsum(np.append(size, np.ones(len(used), np.int64)))])
    return ragged_take(np.append(parts, used), bounds, rows)[0].astype(np.uint32)


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of the expansion; only the symbols that cover them are expanded."""
    size = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(size)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(symbols[a:b], rules, base)[skip : skip + max(0, stop - start)]


def _packed(x: np.ndarray) -> bytes:
    wide = len(x) and int(x.max()) > 0xFFFF
    return (b"4" if wide else b"2") + x.astype("<u4" if wide else "<u2").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4" if x[:1] == b"4" else "<u2", offset=1).astype(np.uint32)


def write(docs: DataFrame, target: str, vocabulary_path: str, key: str = "doc_id", text: str = "text", end: int = END_ID, shard_tokens: int = SHARD_TOKENS, ranges: int | None = None) -> None:
    """Encode every document and write the files under target."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = loaded(LibraryEncoder, spec.value), TaskContext.get().partitionId()
        shard, start, held = 0, 0, 0
        keys: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, held
            ids, size = np.concatenate(parts), np.concatenate(sizes)
            base = encoder.n_ids
            symbols, rules, lengths = compress(ids, base, end)
            ends = np.flatnonzero(symbols == end)
            if len(ends) != len(size):  # a text holds the end id itself
                ends = _document_ends(symbols, lengths, base, size)
            row = [part, shard, keys[0], keys[-1], start, len(ids), base, list(keys), size.tolist(), np.diff(ends, prepend=-1).tolist(), _packed(symbols), _packed(rules.ravel()), _packed(lengths)]
            shard, start, held = shard + 1, start + len(ids), 0
            for x in (keys, parts, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()))], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches, "text"):
            ids, bounds = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            ids, size = np.insert(ids, bounds[1:], end), np.diff(bounds) + 1
            keys += batch.column("key").to_pylist()
            parts.append(ids)
            sizes.append(size)
            held += len(ids)
            if held >= shard_tokens:
                yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(ranges or shuffle_partitions(spark), "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(target)


def _document_ends(symbols: np.ndarray, lengths: np.ndarray, base: int, size: np.ndarray) -> np.ndarray:
    """The symbol that ends each document, where texts may hold the end id themselves."""
    each = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    return np.searchsorted(np.cumsum(each), np.cumsum(size))


def read(spark: SparkSession, target: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and its range, shard and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = expand(_unpacked(r["symbols"]), _unpacked(r["rules"]).reshape(-1, 2), r["base"])
                size = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(size)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), size.tolist())]
                n = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - size, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([r["range"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()), pa.array(r["doc_symbols"], pa.int32())],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "range", "shard", "n_symbols"],
                )

    stored = spark.read.schema(SCHEMA).parquet(target)
    totals = stored.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))  # a row a file
    docs = stored.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, range int, shard int, n_symbols int")
    return docs.join(starts, "range").select("doc_id", (F.col("range_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "range", "shard", "n_symbols")


def tokens_at(spark: SparkSession, target: str, doc_id: int, start: int, n: int) -> list[int]:
    """ids start to start+n of one document, decoded from its shard alone, which the first and last ids of the shards tell."""
    wanted = F.lit(doc_id).cast("bigint")
    row = spark.read.schema(SCHEMA).parquet(target).filter((F.coalesce("first_id", F.lit(-(2**63))) <= wanted) & (F.col("last_id") >= wanted)).filter(F.array_contains("doc_ids", wanted)).first()
    if row is None:
        raise KeyError(doc_id)
    i = row["doc_ids"].index(doc_id)
    first = sum(row["doc_symbols"][:i])
    symbols = _unpacked(row["symbols"])[first : first + row["doc_symbols"][i]]
    return expand_range(symbols, _unpacked(row["rules"]).reshape(-1, 2), _unpacked(row["lengths"]), row["base"], start, min(start + n, row["doc_tokens"][i])).tolist()
