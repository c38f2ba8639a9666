"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring byte symbols that no vocabulary token holds next to each other can never be merged, so every such pair
marks a certain cut. Words (from the vocabulary's own pre-tokenizer) are cut there, each fragment is encoded by itself
and the ids are put together; fragments and words that occur again are looked up. Decoding joins the ids' tokens by the
rule of the vocabulary's decoder.

A null text counts as empty and gives no ids. White-space-only text gives what the vocabulary gives. Texts of any
length are handled whole; equal texts give equal rows; an empty table gives an empty result; only the id and text
columns are read. Ids are carried only: null and repeated ones keep their rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import ragged_take, slices

#: Chunks that a Python worker remembers; twice as many just before the older half goes.
REMEMBERED = 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts without other characters take the short way, where white space is certain and nothing needs normalizing but case.
UNUSUAL = re.compile(f"[^\n -~{_LETTERS}]|<\\|")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: Texts with none of these have full stops and commas only after a letter or digit.
_NOT_PLAIN = f"^[,.]|[^\n ,.{_LETTERS}0-9]|[\n ,.][,.]"
_LOADED: dict[str, object] = {}


class Memory:
    """A bounded dict: when the newer half is full, the older one goes."""

    def __init__(self, most: int = REMEMBERED):
        self.new, self.old, self.most = {}, {}, most

    def look_up(self, keys: list, make) -> list:
        new, old, out = self.new, self.old, []
        for k in keys:
            got = new.get(k)
            if got is None:
                got = old.get(k)
                new[k] = got = make(k) if got is None else got
            out.append(got)
        if len(new) > self.most:
            self.new, self.old = {}, new
        return out


def plain(texts: list[str]) -> list[bool]:
    return pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), _NOT_PLAIN)).to_pylist()


class ChunkIds:
    """The ids of chunks as arrays. Beyond `most` chunks, those older than the newest half go, but for those just used."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.known = most, pa.array([], pa.large_string())
        self.values, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rows(self, chunks: pa.Array, make) -> np.ndarray:
        """Where each of the (distinct) chunks is in the table; make gives the ids of a new one."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(pc.is_null(at))
        rows = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            each = [make(c) for c in new.to_pylist()]
            size = np.fromiter(map(len, each), np.int64, len(each))
            rows[rows < 0] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.values = np.concatenate([self.values, np.fromiter(chain.from_iterable(each), np.int32, int(size.sum()))])
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(size))
        if len(self.known) > self.most:
            keep = np.arange(len(self.known)) >= len(self.known) - self.most // 2
            keep[rows] = True
            place = np.cumsum(keep) - 1
            self.known = self.known.filter(pa.array(keep))
            self.values, self.bounds = ragged_take(self.values, self.bounds, np.flatnonzero(keep))
            rows = place[rows]
        return rows


def ids_of_chunks(split: pa.Array, memory: ChunkIds, make) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of lists of chunks; make gives the ids of a chunk."""
    coded = split.values.dictionary_encode()
    rows = memory.rows(coded.dictionary, make)
    ids, at = ragged_take(memory.values, memory.bounds, rows[coded.indices.to_numpy(zero_copy_only=False)])
    return ids, at[split.offsets.to_numpy()]


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def loaded(kind, spec: str):
    """One instance of a tokenizer class a Python worker and vocabulary."""
    key = f"{kind.__name__}:{hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in _LOADED:
        _LOADED[key] = kind(spec)
    return _LOADED[key]


class ForcedBoundaryBPE:
    """spec: the text of a tokenizers JSON file with byte-level BPE, lower-casing and an end-of-word suffix or none."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        described = json.loads(spec)
        model = described["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: n for n, pair in reversed(list(enumerate(merges)))}
        bare = (t.removesuffix(self.suffix) if self.suffix else t for t in self.ids)
        #: The pairs of symbols that some token holds; any other pair is a cut.
        self.joined = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        self.special = special
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        n = max([*self.ids.values(), *special.values()]) + 1
        tokens = np.full(n, "", object)
        for t, i in chain(self.ids.items(), special.items()):
            tokens[i] = t
        self.tokens, self.numbers = tokens, np.array([str(i) for i in range(n)], object)
        self.byte_decoder = (described.get("decoder") or {}).get("type") == "ByteLevel"
        self.fragments = Memory(REMEMBERED // 5)
        self.chunks = ChunkIds()

    def split(self, word: str) -> list[str]:
        """The fragments of a word of byte symbols between certain cuts."""
        joined, out, at = self.joined, [], 0
        if all(map(joined.__contains__, map(add, word, word[1:]))):
            return [word]
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        parts = list(fragment)
        if last and self.suffix:
            parts[-1] += self.suffix
        get, none = self.ranks.get, len(self.ranks)
        order = [get(pair, none) for pair in zip(parts, parts[1:])]
        while order and (best := min(order)) != none:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = get((parts[i], parts[i + 1]), none)
        ids = self.ids
        return tuple([ids[p] for p in parts if p in ids])

    def merge_long(self, fragment: str, last: bool) -> tuple[int, ...]:
        """As merge, for long fragments: a heap of pairs over a linked list, n log n."""
        import heapq

        parts: list[str | None] = list(fragment)
        if last and self.suffix:
            parts[-1] += self.suffix
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.ids[p] for p in parts if p is not None and p in self.ids)

    def fragment_ids(self, key: tuple[str, bool]) -> tuple[int, ...]:
        return self.merge(*key) if len(key[0]) < 48 else self.merge_long(*key)

    def word_ids(self, word: str) -> tuple[int, ...]:
        pieces = self.split(word)
        if len(pieces) == 1:
            return self.fragment_ids((word, True))
        return tuple(chain.from_iterable(self.fragments.look_up([(p, k == len(pieces) - 1) for k, p in enumerate(pieces)], self.fragment_ids)))

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Of text without white space and unusual characters, in lower case."""
        out: tuple[int, ...] = ()
        for w in _WORDS.findall(chunk):
            out += self.word_ids(w if w.isascii() else w.encode().decode("latin-1").translate(self.symbols))
        return out

    def any_ids(self, text: str) -> list[int]:
        """Of any text: special tokens first, then the vocabulary's own normalizer and pre-tokenizer."""
        out: list[int] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if self.library.normalizer:
                    part = self.library.normalizer.normalize_str(part)
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    out += self.word_ids(w)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds)."""
        simple = plain(texts)
        usual = [p or not UNUSUAL.search(t) for p, t in zip(simple, texts)]
        short = [t.lower().replace("\n", " ") if u else "" for t, u in zip(texts, usual)]
        split = pc.split_pattern(pa.array([t.replace(".", " .").replace(",", " ,") if p else t for t, p in zip(short, simple)], pa.large_string()), " ")
        ids, bounds = ids_of_chunks(split, self.chunks, self.chunk_ids)
        if not all(usual):
            each = [ids[bounds[i] : bounds[i + 1]] if u else np.array(self.any_ids(t), np.int32) for i, (t, u) in enumerate(zip(texts, usual))]
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds

    def decode(self, ids: np.ndarray) -> str:
        tokens = self.tokens[ids].tolist()
        if not self.byte_decoder:
            return " ".join(tokens)
        back = {s: i for i, s in self.symbols.items()}
        return b"".join(t.encode() if t in self.special else bytes(back[c] for c in t) for t in tokens).decode(errors="replace")


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ids array<int>, n_tokens, the checksum of the ids and of the decoded text.

    path: the vocabulary file, read on the driver and sent to the executors (a file of fixed size).
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ForcedBoundaryBPE, spec.value)
        for batch in slices(batches, "text"):
            ids, bounds = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            numbers, decoded = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = ids[a:b]
                numbers.append(hashlib.sha256(" ".join(bpe.numbers[part].tolist()).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(part).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(bounds), pa.int64()), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and the text of its ids; null ids give a null text."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ForcedBoundaryBPE, spec.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
