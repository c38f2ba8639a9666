import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from mosaiq.llm import bpe, token_store


@pytest.fixture(scope="module")
def word_path():
    return P.path("word_bpe_49k.json")


def test_encode_equals_library(corpus, texts, word_path):
    library = Tokenizer.from_file(word_path)
    rows = {r["doc_id"]: r for r in bpe.encode(corpus, word_path).collect()}
    assert set(rows) == set(texts)
    for k, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[k]["ids"] == ids and rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode(corpus, texts, word_path):
    library = Tokenizer.from_file(word_path)
    for r in bpe.decode(bpe.encode(corpus, word_path), word_path).collect():
        assert r["text"] == library.decode(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_cuts_are_certain_and_long_fragments_agree(word_path):
    model = bpe.ForcedBoundaryBPE(bpe.vocabulary(word_path))
    bare = [t.removesuffix("</w>") for t in model.ids]
    assert all(model.split(t) == [t] for t in bare[:5000] if t)
    assert "".join(model.split("abc€xyzqqwv")) == "abc€xyzqqwv"
    for w in ("abababab" * 9, "zzzqqq" * 12, "lowercaseword" * 5):
        assert model.merge(w, True) == model.merge_long(w, True)


def test_byte_level_vocabulary_round_trip():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    model = token_store.LibraryEncoder(bpe.vocabulary(path))
    samples = ["Plain words, here.\nNext line", "a  b", "x\n\ny", " lead", "don't WE'LL 12345 -- ünï", "日本 <|endoftext|> z", "", "ab.cd, ef..gh ,x", "q" * 400]
    ids, bounds = model.encode(samples)
    for i, s in enumerate(samples):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(s, add_special_tokens=False).ids, s


def test_token_files(spark, corpus, texts, tmp_path):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    target = str(tmp_path / "ids")
    token_store.write(corpus, target, path, shard_tokens=2000, ranges=3)
    rows = {r["doc_id"]: r for r in token_store.read(spark, target).collect()}
    start = 0
    for k in sorted(texts):
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        r = rows[k]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    long_ids = library.encode(texts[13], add_special_tokens=False).ids
    assert token_store.tokens_at(spark, target, 13, 777, 300) == long_ids[777:1077]
    assert token_store.tokens_at(spark, target, 3, 0, 5) == [2]


def test_repair_round_trip_with_end_ids_inside():
    r = np.random.default_rng(1)
    ids = r.integers(3, 9, 5000).astype(np.int32)
    ids[99::100] = 2
    ids[7] = 2  # a text that holds the end id
    symbols, rules, lengths = token_store.compress(ids, 100)
    assert len(rules) and len(symbols) < len(ids)
    assert (token_store.expand(symbols, rules, 100) == ids).all()
    for a, b in ((0, 5000), (10, 11), (123, 4567), (4990, 5000)):
        assert (token_store.expand_range(symbols, rules, lengths, 100, a, b) == ids[a:b]).all()
    assert [token_store.expand(np.array([100 + i], np.uint32), rules, 100).size for i in range(len(rules))] == lengths.tolist()


def test_empty_and_clashing(spark, empty, clashing, word_path, tmp_path):
    assert bpe.encode(empty, word_path).count() == 0
    assert bpe.encode(clashing, word_path).count() == clashing.count()
    target = str(tmp_path / "clashing")
    token_store.write(clashing, target, P.path("byte_bpe_50k.json"))
    assert token_store.read(spark, target).count() == clashing.count()
    target = str(tmp_path / "none")
    token_store.write(empty, target, P.path("byte_bpe_50k.json"))
    assert token_store.read(spark, target).count() == 0


def test_grammar_goes_on_to_its_end():
    r = np.random.default_rng(5)
    pieces = [r.integers(3, 400, n) for n in r.integers(2, 40, 60)]
    ids = np.concatenate([np.append(pieces[i], 2) for i in r.integers(0, 60, 3000)])
    symbols, rules, lengths = token_store.compress(ids, 1000)
    assert (token_store.expand(symbols, rules, 1000) == ids).all()
    assert lengths.max() > 20
    pairs = [(a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if 2 not in (a, b)]
    assert max(Counter(pairs).values(), default=0) < token_store.MIN_COUNT
    same = np.full(5000, 7)
    symbols, rules, _ = token_store.compress(same, 10)
    assert len(symbols) < 20 and (token_store.expand(symbols, rules, 10) == same).all()


def test_token_files_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "b b"), (5, "a a a"), (None, "n"), (5, "a a a"), (7, None), (None, "m")]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        want.append((k, start, n))
        start += n
    for parts in (1, 3):
        target = str(tmp_path / f"repeats{parts}")
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), target, P.path("byte_bpe_50k.json"))
        got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read(spark, target).orderBy("start").collect()]
        assert got == want
    assert token_store.tokens_at(spark, target, 7, 0, 9) == [2]


def test_chunk_table_forgets():
    table = bpe.ChunkIds(most=10)
    for low in range(0, 200, 7):
        chunks = [str(i) for i in range(low, low + 9)]
        rows = table.rows(pa.array(chunks, pa.large_string()), lambda c: (int(c),) * (int(c) % 3))
        for c, row in zip(chunks, rows):
            assert table.values[table.bounds[row] : table.bounds[row + 1]].tolist() == [int(c)] * (int(c) % 3)
    assert len(table.known) <= 25
